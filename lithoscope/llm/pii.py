"""PII surrogates: detected entities get keyed, type-consistent replacements.

Entities are e-mail and IP addresses, payment cards, IBANs, social security numbers, phone numbers, secrets (long hexadecimal
strings and API keys) and persons after a title. Each is brought to a canonical form, so that spellings of one entity get
one surrogate (coreference), and each distinct (kind, canonical form) is replaced once. A person's given and family names
are entities of their own, so that `Mr. John Smith` and `Mr. Smith` stay one family.

A surrogate is a function of the secret key, the kind, the canonical form and an attempt number: letters become letters of
the same case and script, digits digits; addresses stay valid; a card that passes the Luhn test has a surrogate that
does; given names have the title's gender. Surrogates that coincide with another's, or with an entity of the texts,
are drawn again with the next attempt, until all are distinct (the one with the smallest canonical form stays).
A mention takes its own punctuation and case from the text.

Everything runs on built-in functions. Counting, drawing and checking work on distinct entities; a frequent entity is joined
by AQE's skew join. Cases: null texts stay null; texts without entities stay as they are. Repeated rows get the same
replacements. Other columns stay as they are, whatever their names; n_entities is
replaced. Very long texts are matched whole, each start in one pass over a word. Ties of a collision go to the smallest
canonical form. Where an entity finds no free surrogate in MOST_DRAWS draws, the run fails and says so. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoscope.llm.common import Table, attach, text_of

#: The key if neither an argument nor the session's KEY_SETTING gives one. It is public: give your own.
KEY, KEY_SETTING = "lithoscope", "spark.lithoscope.pii.key"
#: Draws of one entity before the run fails; names get longer with each, the other kinds have as many forms as their shape.
MOST_DRAWS = 64
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Titles by gender. Fixed values.
MALE = ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Sr", "Señor", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Frau", "Mme", "Mlle", "Madame", "Mademoiselle", "Sra", "Srta", "Señora", "Señorita", "г-жа")
OTHER = ("Dr", "Prof")
NAME = r"\p{Lu}[\p{L}'’]*\p{Ll}"
#: Kind and pattern, the first that fits wins. Possessive runs and look-behind keep each start to one pass over a word.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?![\w]|\.[0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|(?:AKIA|ghp_|gho_|sk-|pk-|xox[abp]-)[A-Za-z0-9_-]{12,}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w.])(?:[0-9]{13,19}+|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7})(?!\w)",
    "phone": r"(?<![\w+.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\)[ .-]?|[0-9]{2,5}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?!\w)|(?<![\w+])\+[0-9]{8,15}(?!\w)",
    "person": rf"(?<![\p{{L}}])(?:{'|'.join((*MALE, *FEMALE, *OTHER))})\.? {NAME}(?:[ -]{NAME}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Given names by script and gender, from which surrogates are drawn, and syllables of family names. Fixed values.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Karl Leo Martin Nils Oscar Paul Quentin Robert Simon Tomas Victor Walter Xavier Yann Zeno".split(),
    ("latin", "f"): "Anna Berta Clara Diana Elena Flora Greta Helena Irene Julia Karin Laura Maria Nora Olga Paula Rita Sara Teresa Ursula Vera Wanda Xenia Yvonne Zoe".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Тимур Фёдор Юрий".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса София Тамара Юлия".split(),
}
SYLLABLES = {"latin": "ba co da fe gi ha jo ka li mo na pe ri so tu va wi zo bel dor fal gan har lin mar nor pel ros sal ten vil wen".split(), "cyrillic": "ба во да же зи ко ла ми но пе ра со ту фе хо ца ше бел дор гал кор лин мар нор пел рос сал тен вил зар".split()}
KEYS = ["__id", "__hash"]


def kind_of(mention: Column) -> Column:
    out = F.lit("person")
    for kind, pattern in reversed([p for p in PATTERNS.items() if p[0] != "person"]):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, mention: Column) -> Column:
    digits = F.regexp_replace(mention, "[^0-9]", "")
    plain = F.upper(F.regexp_replace(mention, "[^A-Za-z0-9]", ""))
    # A key's case matters; a hexadecimal string's doesn't.
    secret = F.when(mention.rlike("^[0-9A-Fa-f]+$"), F.lower(mention)).otherwise(mention)
    return F.when(kind == "email", F.lower(mention)).when(kind.isin("card", "ssn", "phone"), digits).when(kind == "iban", plain).when(kind == "secret", secret).otherwise(mention)


def mentions(plain: DataFrame) -> DataFrame:
    """plain (KEYS, __text) -> KEYS, nth, part, mention, kind, canon: a row for each entity, persons by their names."""
    found = plain.select(*KEYS, F.posexplode(F.regexp_extract_all("__text", F.lit(ANY), 0)).alias("nth", "mention"))
    found = Table(found.select("*", kind_of(F.col("mention")).alias("kind")), "found").df
    male, female = (rf"^(?:{'|'.join(t)})\b" for t in (MALE, FEMALE))
    gender = F.when(F.col("mention").rlike(female), "f").when(F.col("mention").rlike(male), "m").otherwise("n")
    script = lambda c: F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    names = F.slice(F.split("mention", " "), 2, 9)
    person = found.filter("kind = 'person'").select(*KEYS, "nth", gender.alias("gender"), names.alias("names"))
    person = person.select(*KEYS, "nth", "gender", F.size("names").alias("n"), F.posexplode("names").alias("part", "mention"))
    role = F.when(F.col("part") == F.col("n") - 1, F.concat(F.lit("family."), script(F.col("mention")))).otherwise(F.concat(F.lit("given."), script(F.col("mention")), F.lit("."), F.col("gender")))
    person = person.select(*KEYS, "nth", "part", "mention", role.alias("kind"), F.initcap("mention").alias("canon"))
    rest = found.filter("kind <> 'person'").select(*KEYS, "nth", F.lit(0).alias("part"), "mention", "kind", canonical(F.col("kind"), F.col("mention")).alias("canon"))
    return rest.unionAll(person)


def stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Sixty-four hexadecimal digits that only the key's owner can foresee."""
    return F.sha2(F.concat_ws("\x00", F.lit(key), kind, canon, attempt.cast("string"), F.lit(key)), 256)


def number(hexes: Column, at, width: int = 4) -> Column:
    """An integer from the stream at a place, which may lie past its end."""
    return F.conv(F.substring(F.concat(hexes, hexes), (at * width) % 64 + 1, width) if isinstance(at, int) else F.substr(F.concat(hexes, hexes), (at * width) % 64 + F.lit(1), F.lit(width)), 16, 10).cast("int")


def pick(values: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), n % len(values))


def reshaped(canon: Column, hexes: Column) -> Column:
    """Digits to digits, letters to letters of the same case and script, all else kept. A long form runs through the stream
    again with the place added, so that its repetition doesn't show."""
    letter = lambda start, size, n: F.decode(F.unhex(F.lpad(F.hex(F.lit(start) + n % size), 4, "0")), "UTF-16BE")

    def one(c, i):
        n = number(hexes, i) + F.shiftright(i, 4) * 7
        return (
            F.when(c.rlike("^[0-9]$"), (n % 10).cast("string")).when(c.rlike("^[a-z]$"), letter(97, 26, n)).when(c.rlike("^[A-Z]$"), letter(65, 26, n))
            .when(c.rlike("^[а-я]$"), letter(0x430, 32, n)).when(c.rlike("^[А-Я]$"), letter(0x410, 32, n)).when(c.rlike(r"^\p{Ll}$"), letter(97, 26, n)).when(c.rlike(r"^\p{Lu}$"), letter(65, 26, n)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(canon, ""), one), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum: every second digit from the right doubled, less nine above nine."""
    size = F.char_length(digits)

    def value(c, i):
        d = c.cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return F.when((size - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, x: a + x)


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) -> with surrogate."""
    d = entities.withColumn("hex", stream(key, F.col("kind"), F.col("canon"), F.col("attempt")))
    h, canon, kind = F.col("hex"), F.col("canon"), F.col("kind")
    domain = F.split(canon, "@")[1]
    same_shape = reshaped(canon, h)
    email = F.concat(reshaped(F.split(canon, "@")[0], h), F.lit("@"), reshaped(F.regexp_replace(domain, r"\.[^.]*$", ""), F.reverse(h)), F.lit(".example"))
    ip = F.concat_ws(".", (1 + number(h, 0) % 223).cast("string"), *[(number(h, i) % 256).cast("string") for i in (1, 2, 3)])
    body = F.substr(same_shape, F.lit(1), F.char_length(canon) - 1)
    check = F.concat(body, ((10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    card = F.when(luhn(F.when(kind == "card", canon).otherwise(F.lit("0"))) % 10 == 0, check).otherwise(same_shape)
    hexadecimal = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.hex(F.pmod(number(h, i) + F.shiftright(i, 4) * 7, F.lit(16)))), "")
    prefix = F.regexp_extract(canon, "^(?:AKIA|ghp_|gho_|sk-|pk-|xox[abp]-)", 0)
    secret = F.when(canon.rlike("^[0-9A-Fa-f]+$"), F.lower(hexadecimal)).otherwise(F.concat(prefix, reshaped(F.regexp_replace(canon, "^(?:AKIA|ghp_|gho_|sk-|pk-|xox[abp]-)", ""), h)))
    iban = F.concat(F.substring(canon, 1, 2), reshaped(F.substring(canon, 3, 99), h))
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "secret", secret).when(kind == "iban", iban)
    for script, parts in SYLLABLES.items():
        # Each attempt after the second adds a syllable: the names can't run out.
        more = F.array_join(F.transform(F.sequence(F.lit(0), 2 + F.shiftright("attempt", 1)), lambda i: pick(parts, number(h, i))), "")
        out = out.when(kind == f"family.{script}", F.initcap(more))
        for gender in ("m", "f", "n"):
            given = GIVEN[script, gender] if gender != "n" else GIVEN[script, "m"] + GIVEN[script, "f"]
            several = F.concat(pick(given, number(h, 0)), F.when(F.col("attempt") > 0, F.lower(F.array_join(F.transform(F.sequence(F.lit(1), 1 + F.shiftright("attempt", 1)), lambda i: pick(parts, number(h, i))), ""))).otherwise(""))
            out = out.when(kind == f"given.{script}.{gender}", several)
    return d.withColumn("surrogate", out.otherwise(same_shape)).drop("hex")


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """distinct (kind, canon) -> with surrogate: distinct within a kind, and none of them an entity of the kind.

    Each round draws again for those that lost a collision; the rounds end when nobody did. An attempt adds freedom for
    names; the other kinds have far more forms than a corpus has entities."""
    originals = Table(entities.select("kind", "canon"), "entities")
    settled, rounds = None, 0
    waiting = originals.df.withColumn("attempt", F.lit(0))
    while True:
        tried = Table(drawn(waiting, key), "drawn")
        firsts = tried.df.groupBy("kind", "surrogate").agg(F.min("canon").alias("first"))
        taken = originals.df.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
        judged = attach(attach(tried.df, firsts, ["kind", "surrogate"]), taken, ["kind", "surrogate"])
        if settled is not None:
            judged = attach(judged, settled.select("kind", "surrogate", F.lit(True).alias("used")), ["kind", "surrogate"])
        else:
            judged = judged.withColumn("used", F.lit(None).cast("boolean"))
        judged = Table(judged.withColumn("good", (F.col("first") == F.col("canon")) & F.col("real").isNull() & F.col("used").isNull()), "judged")
        good = judged.df.filter("good").select("kind", "canon", "surrogate")
        settled = good if settled is None else settled.unionAll(good)
        waiting = judged.df.filter("NOT good").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        tried.drop()
        if waiting.isEmpty():
            return settled
        rounds += 1
        if rounds >= MOST_DRAWS:
            kinds = [r.kind for r in waiting.select("kind").distinct().collect()]  # as many as PATTERNS has, with scripts and genders
            raise ValueError(f"no free surrogates are left for some entities of {', '.join(sorted(kinds))}")


def rendered(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate with the mention's punctuation and case."""
    marks = F.split(mention, "")
    taken = lambda i: F.char_length(F.regexp_replace(F.substr(mention, F.lit(1), i), "[^A-Za-z0-9]", ""))
    laid = F.array_join(F.transform(marks, lambda c, i: F.when(c.rlike("^[A-Za-z0-9]$"), F.substr(surrogate, taken(i) + 1, F.lit(1))).otherwise(c)), "")
    cased = F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("card", "ssn", "phone", "iban"), laid).when((kind == "email") | kind.startswith("family") | kind.startswith("given"), cased).when((kind == "secret") & mention.rlike("^[0-9A-F]+$"), F.upper(surrogate)).otherwise(surrogate)


def replace_pii(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col's entities replaced, and n_entities (what it replaces, if docs has one)."""
    text = text_of(text_col)
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    keyed = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__hash"), text.alias("__text"), F.struct("*").alias("__row"))
    found = Table(mentions(keyed.select(*KEYS, "__text")).distinct(), "mentions").df
    chosen = Table(surrogates(found.select("kind", "canon").distinct(), key), "surrogates").df
    named = attach(found, chosen, ["kind", "canon"]).withColumn("new", rendered(F.col("kind"), F.col("mention"), F.col("surrogate")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("part", "new"))), lambda x: x["new"])
    by_mention = named.groupBy(*KEYS, "nth").agg(F.array_join(parts, " ").alias("new"))
    by_row = by_mention.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "new"))), lambda x: x["new"]).alias("__new"))
    by_row = by_row.select(F.col("__id").alias("__eid"), F.col("__hash").alias("__ehash"), "__new")
    joined = keyed.join(by_row, F.col("__id").eqNullSafe(F.col("__eid")) & (F.col("__hash") == F.col("__ehash")), "left")
    old = F.regexp_extract_all("__text", F.lit(ANY), 0)
    joined = joined.withColumns({"__gaps": F.when(F.col("__new").isNotNull(), F.split("__text", ANY, -1)), "__old": F.when(F.col("__new").isNotNull(), old)})
    title = lambda i: F.regexp_extract(F.get("__old", i), rf"^(?:{'|'.join((*MALE, *FEMALE, *OTHER))})\.? ", 0)
    entity = lambda i: F.concat(title(i), F.get("__new", i))
    whole = F.array_join(F.transform("__gaps", lambda gap, i: F.concat(gap, F.when(i < F.size("__old"), entity(i)).otherwise(""))), "")
    new = {text_col: F.when(F.col("__new").isNull(), F.col("__row").getField(text_col)).otherwise(whole), "n_entities": F.coalesce(F.size("__old"), F.lit(0)).cast("long")}
    columns = [*docs.columns, *(["n_entities"] if "n_entities" not in docs.columns else [])]
    return joined.select(*[(new[c] if c in new else F.col("__row").getField(c)).alias(c) for c in columns])

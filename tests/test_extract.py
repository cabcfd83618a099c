import pytest
from pyspark.sql import functions as F

from lithoscope.functions.text import is_binary, language, normal_path
from lithoscope.operators import extract, resolve, similarity


def frame(spark, texts):
    rows = [(p, t) for p, t in texts.items()]
    return spark.createDataFrame(rows, "path string, text string").withColumns({"lang": language("path"), "is_binary": is_binary("path")})


TEXTS = {
    "a.ts": "import x from './x';\nimport './side.js'\n// import z from \"./comment\"\nexport { y } from './z';\nimport y from './x';",
    "b.js": "éspawn(1); spawn (2)\nre.exec(s)\nprocess.env.FOO == 1; Process.Env.bar = 2",
    "c.ts": "http\n .createServer(f)\n\nx; listen(80,\n '0.0.0.0')",
    "d.ts": "const q = require( \"./q\" ); import('./dyn')  ;",
}


def test_imports(spark):
    got = sorted((r.path, r.spec, r.kind) for r in extract.extract_imports(frame(spark, TEXTS)).collect())
    assert got == [("a.ts", "./comment", "import"), ("a.ts", "./side.js", "import"), ("a.ts", "./x", "import"), ("a.ts", "./x", "import"), ("d.ts", "./dyn", "dynamicImport"), ("d.ts", "./q", "require")]
    legacy = {(r.path, r.spec, r.kind) for r in extract.extract_imports_legacy(frame(spark, TEXTS)).collect()}
    assert ("a.ts", "./z", "import") in legacy and len([x for x in legacy if x[1] == "./x"]) == 1


def test_signals(spark):
    got = sorted((r.file, r.kind, r.line, r.snippet) for r in extract.runtime_signals(frame(spark, TEXTS)).collect())
    assert got == [
        ("b.js", "envMutation", 3, "Process.Env.bar = 2"), ("b.js", "envMutation", 3, "process.env.FOO == 1; Process.Env.bar = 2"), ("b.js", "exec", 2, "exec(s)"),
        ("b.js", "spawn", 1, "spawn (2)"), ("b.js", "spawn", 1, "spawn(1); spawn (2)"), ("c.ts", "bindAllInterfaces", 4, "listen(80,"), ("c.ts", "httpServer", 1, "http"),
    ]


def test_exports(spark):
    text = "export function f() {}\nexport class C {}\nexport const f = 1;\nexport type T = 1;\nexport interface I {}\nexport { a as b, type U, C, };"
    got = sorted((r.name, r.kind) for r in extract.extract_exports(frame(spark, {"a.ts": text})).collect())
    assert got == [("C", "class"), ("I", "interface"), ("T", "type"), ("U", "export"), ("a", "export"), ("f", "function")]


PATHS = ["src/myutil.ts", "src/util.ts", "lib/index.ts", "index.js", "src/a/index.mjs", "z.json", "src/verylongname_module_part.ts", "q7.ts", "7.ts"]


@pytest.mark.parametrize("norm", ["util", "", "7", "index", "lib", "a", "src/a", "verylongname_module_part", "z.json", "nothing", "x/util"])
def test_suffixes_against_all_paths(spark, norm):
    files = spark.createDataFrame([(p,) for p in PATHS], "path string")
    got = resolve.resolve_suffix(spark.createDataFrame([(norm,)], "norm string"), files).collect()
    import re

    fits = [p for p in sorted(PATHS) if (b := re.sub(r"\.(ts|js|mjs|cjs)$", "", p)).endswith(norm) or b.endswith(norm + "/index")]
    assert [r.to for r in got] == fits[:1]


def test_probe(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b/index.tsx",), ("lib/c.js",)], "path string")
    edges = spark.createDataFrame([("src/a.ts", "./b"), ("src/b/index.tsx", "../a"), ("src/a.ts", "lib/c.js"), ("src/a.ts", "node:fs"), ("src/a.ts", "react"), ("src/a.ts", "@x")], "from string, to string")
    got = {r.to: r.resolved for r in resolve.resolve_probe(edges, files, {"*": ["./*"], "@x": ["./src/b"]}).collect()}
    assert got == {"./b": "src/b/index.tsx", "../a": "src/a.ts", "lib/c.js": "lib/c.js", "node:fs": None, "react": None, "@x": "src/b/index.tsx"}


def test_paths(spark):
    got = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a//b",), ("a/../../y",)], "p string").select(normal_path(F.col("p")).alias("n")).collect()
    assert [r.n for r in got] == ["a/c", "../x", "a/b", "../y"]
    langs = spark.createDataFrame([("a.ts",), ("a.tsx",), ("A.TS",), ("x.cjs",), ("noext",), ("p.PNG",)], "path string").select(language("path").alias("l"), is_binary("path").alias("b")).collect()
    assert [(r.l, r.b) for r in langs] == [("ts", False), ("unknown", False), ("unknown", False), ("js", False), ("unknown", False), ("unknown", True)]


def test_simhash(spark):
    import hashlib

    texts = {"a.md": "", "b.md": "one two two three", "c.md": " one\ttwo two\nthree ", "d.md": "one two two four five six seven", "e.md": " x﻿y"}

    def plain(t):
        votes = [0] * 64
        for w in t.replace(" ", " ").replace("﻿", " ").split():
            h = int(hashlib.sha256(w.encode()).hexdigest()[:16], 16)
            votes = [v + (1 if h >> (63 - i) & 1 else -1) for i, v in enumerate(votes)]
        return f"{int(''.join('1' if v > 0 else '0' for v in votes), 2):016x}"

    hashes = similarity.simhash64(frame(spark, texts))
    got = {r.path: r.simhash for r in hashes.collect()}
    assert got == {p: plain(t) for p, t in texts.items()}
    pairs = [(r.path_a, r.path_b, r.hamming) for r in similarity.duplicate_pairs(hashes).collect()]
    assert ("b.md", "c.md", 0) in pairs

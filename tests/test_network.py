from lithoscope.plans import network


def test_components_of_the_whole_customer_supplier_graph(spark, tmp_path):
    orders = [(k, k % 40) for k in range(60)]
    items = [(k, 1000 + (k * 7 + j) % 30 * (1 + k % 40 // 20), 1 + (k + j) % 50) for k in range(60) for j in range(2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_suppkey long, l_quantity long").write.parquet(f"{tmp_path}/lineitem.parquet")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    customer = dict(orders)
    for k, supplier, _ in items:
        a, b = find(f"c{customer[k]}"), find(f"s{supplier}")
        root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in network.weak_components_all(spark, str(tmp_path)).collect()}
    assert got == {x: find(x) for x in root}

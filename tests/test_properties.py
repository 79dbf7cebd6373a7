"""Property tests: Spark operators vs straightforward Python on random inputs."""

import math

from hypothesis import HealthCheck, given, settings, strategies as st

from storelens.operators.catalog import variant_rollup
from storelens.operators.search import filter_products

price = st.one_of(st.none(), st.floats(min_value=0, max_value=100, allow_nan=False).map(lambda x: round(x, 2)))
product = st.tuples(st.sampled_from(["A", "B", "C"]), price, price, st.one_of(st.none(), st.booleans()))
FILTER = st.fixed_dictionaries({
    "product_type": st.one_of(st.none(), st.sampled_from(["", "A", "B"])),
    "min_price": st.one_of(st.none(), st.sampled_from([0.0, 10.0, 50.0])),
    "max_price": st.one_of(st.none(), st.sampled_from([0.0, 20.0, 80.0])),
    "has_discount": st.one_of(st.none(), st.booleans()),
})
SETTINGS = settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def py_filter(rows, f):
    out = []
    for i, (pt, lo, hi, disc) in enumerate(rows):
        ok = True
        if f["product_type"]:
            ok &= pt == f["product_type"]
        if f["min_price"] is not None:
            ok &= hi is not None and hi >= f["min_price"]
        if f["max_price"] is not None:
            ok &= lo is not None and lo <= f["max_price"]
        if f["has_discount"] is not None:
            ok &= disc is not None and disc == f["has_discount"]
        if ok:
            out.append(i)
    return out


@SETTINGS
@given(rows=st.lists(product, max_size=12), f=FILTER)
def test_filter_products_matches_python(spark, rows, f):
    data = [(i, "t", pt, lo, hi, d) for i, (pt, lo, hi, d) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, tenant_id string, product_type string, min_price double, "
                                     "max_price double, has_discount boolean")
    got = sorted(r.id for r in filter_products(df, "t", **f).collect())
    assert got == py_filter(rows, f)


text_price = st.one_of(st.none(), st.just(""), st.just("abc"), st.just("0.00"),
                       st.floats(min_value=0, max_value=999, allow_nan=False).map(lambda x: f"{x:.2f}"))


def py_rollup(variants):
    prices, disc = [], False
    for p, c in variants:
        if p:
            try:
                x = float(p)
            except ValueError:
                continue
            prices.append(x)
            if c:
                try:
                    if float(c) > x:
                        disc = True
                except ValueError:
                    pass
    return (min(prices) if prices else None, max(prices) if prices else None, disc)


@SETTINGS
@given(docs=st.lists(st.one_of(st.none(), st.lists(st.tuples(text_price, text_price), max_size=5)), max_size=6))
def test_variant_rollup_matches_python(spark, docs):
    data = [(i, None if v is None else [{"price": p, "compare_at_price": c} for p, c in v]) for i, v in enumerate(docs)]
    df = spark.createDataFrame(data, "id long, variants array<struct<price:string, compare_at_price:string>>")
    got = {r.id: tuple(r.r) for r in df.select("id", variant_rollup("variants").alias("r")).collect()}
    for i, v in enumerate(docs):
        exp = py_rollup(v or [])
        lo, hi, d = got[i]
        assert d == exp[2]
        assert (lo is None and exp[0] is None) or math.isclose(lo, exp[0])
        assert (hi is None and exp[1] is None) or math.isclose(hi, exp[1])

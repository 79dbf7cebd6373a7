"""Scalar functions X1-X20 on tiny frames with NULL / edge rows."""

from pyspark.sql import functions as F

from storelens.functions import (clean_html, clean_variant_ids, cosine_similarity, duration_minutes,
                                 embedding_json, extract_links, fact_sheet, format_price, is_uuid,
                                 merge_settings, options_map, parse_ts, safe_numbers, split_tags,
                                 total_tokens, transcript_line, usage_cost)

from conftest import ts


def one(spark, expr, data, schema):
    return spark.createDataFrame(data, schema).select(expr.alias("r")).collect()


def test_clean_html_matches_python_semantics(spark):
    import re
    samples = ["<p>Hello&nbsp;<b>World</b></p>", None, "", "a  b c", "<script>var x=1;</script>  tail",
               "\n\t lead and trail \t\n", "x\x1cy"]
    rows = one(spark, clean_html("h"), [(s,) for s in samples], "h string")

    def py(s):
        if not s:
            return ""
        t = re.sub(r"<[^>]+>", " ", s)
        return re.sub(r"\s+", " ", t).strip()
    assert [r.r for r in rows] == [py(s) for s in samples]


def test_extract_links_distinct(spark):
    rows = one(spark, extract_links("h"), [('<a href="/a">x</a><a href="/b"></a><a href="/a"></a>',)], "h string")
    assert sorted(rows[0].r) == ["/a", "/b"]


def test_options_map_blank_and_duplicate_names(spark):
    data = [([("Color", ["Red"]), ("", ["x"]), ("Color", ["Green"]), ("Size", ["S"])],), (None,)]
    rows = one(spark, options_map("o"), data, "o array<struct<name:string, values:array<string>>>")
    assert rows[0].r == {"Color": ["Green"], "Size": ["S"]}
    assert rows[1].r == {}


def test_embedding_json_keeps_nulls_and_order(spark):
    data = [("T", None, "a, b", "V", [("Size", ["S"])], "<p>Café</p>")]
    rows = one(spark, embedding_json("t", "pt", "tags", "v", "o", "b"), data,
               "t string, pt string, tags string, v string, o array<struct<name:string, values:array<string>>>, b string")
    assert rows[0].r == '{"title":"T","product_type":null,"tags":"a, b","vendor":"V","options":{"Size":["S"]},"description":"Café"}'


def test_parse_ts(spark):
    data = [("2024-01-02T10:00:00-05:00",), ("2024-01-02T10:00:00Z",), ("",), ("garbage",), (None,),
            ("2024-01-02 03:04:05",), ("2024-01-02T10:00:00.123456+05:30",), ("20240102T100000Z",)]
    rows = one(spark, parse_ts("s"), data, "s string")
    assert rows[6].r == ts("2024-01-02 04:30:00.123456") and rows[7].r == ts("2024-01-02 10:00:00")
    assert rows[0].r == ts("2024-01-02 15:00:00")
    assert rows[1].r == ts("2024-01-02 10:00:00")
    assert rows[2].r is None and rows[3].r is None and rows[4].r is None
    assert rows[5].r == ts("2024-01-02 03:04:05")


def test_safe_numbers_joint_null(spark):
    data = [("20.00", "25.00", "1.5"), ("", None, ""), ("abc", "10", "2"), ("35.5", "abc", "2"), ("0.00", "0.00", None)]
    rows = one(spark, safe_numbers("p", "c", "w"), data, "p string, c string, w string")
    assert tuple(rows[0].r) == (20.0, 25.0, 1.5)
    assert tuple(rows[1].r) == (None, None, None)
    assert tuple(rows[2].r) == (None, None, None)
    assert tuple(rows[3].r) == (None, None, None)
    assert tuple(rows[4].r) == (0.0, 0.0, None)


def test_variant_ids_and_tags(spark):
    rows = spark.createDataFrame([([1, None, 2], "a, b"), (None, ""), (None, None)], "v array<bigint>, t string") \
        .select(clean_variant_ids("v").alias("v"), split_tags("t").alias("t")).collect()
    assert rows[0].v == [1, 2] and rows[0].t == ["a", "b"]
    assert rows[1].v == [] and rows[1].t == [] and rows[2].t == []


def test_cosine_similarity(spark):
    rows = one(spark, cosine_similarity("a", "b"), [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])],
               "a array<double>, b array<double>")
    assert abs(rows[0].r - 0.7071067811865475) < 1e-12
    assert rows[1].r is None


def test_format_price_and_fact_sheet(spark):
    data = [(10.0, 10.0, True, "a, b", "T", "V"), (1.005, 2.5, False, "", "T", None), (None, None, None, None, None, None)]
    df = spark.createDataFrame(data, "lo double, hi double, d boolean, tags string, t string, v string")
    rows = df.select(format_price("lo", "hi").alias("p"),
                     fact_sheet("t", "v", "lo", "hi", "d", "tags").alias("s")).collect()
    assert rows[0].p == "$10.00"
    assert rows[1].p == "$1.00 - $2.50"
    assert rows[2].p is None
    assert rows[0].s == "Name: T\nBrand: V\nPrice Range: $10.00\nOn Sale: Yes\nTags: a, b"
    assert rows[2].s.endswith("Price Range: Not available\nOn Sale: No\nTags: Not specified")


def test_usage_helpers(spark):
    df = spark.createDataFrame([(1000, 500, None, ts("2024-01-01 00:00:00"), ts("2024-01-01 00:30:00"))],
                               "p long, c long, t long, a timestamp, b timestamp")
    r = df.select(usage_cost("p", "c", F.lit(0.15), F.lit(0.60)).alias("cost"),
                  total_tokens("t", "p", "c").alias("tot"), duration_minutes("a", "b").alias("m")).first()
    assert abs(r.cost - (1000 / 1e6 * 0.15 + 500 / 1e6 * 0.60)) < 1e-15
    assert r.tot == 1500 and r.m == 30.0


def test_merge_settings_and_uuid(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}, "123e4567-e89b-12d3-a456-426614174000"),
                                (None, {"x": "y"}, "nope")], "o map<string,string>, n map<string,string>, u string")
    rows = df.select(merge_settings("o", "n").alias("m"), is_uuid("u").alias("u")).collect()
    assert rows[0].m == {"a": "1", "b": "3"} and rows[0].u is True
    assert rows[1].m == {"x": "y"} and rows[1].u is False


def test_transcript_line(spark):
    rows = one(spark, transcript_line("r", "t"), [("user", "hi"), ("assistant", None), ("system", "x")],
               "r string, t string")
    assert [r.r for r in rows] == ["USER: hi\n", "CHATBOT: \n", None]

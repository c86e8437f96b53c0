import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from capsonde.functions import numbering as N
from capsonde.functions import scalars as S
from capsonde.functions import text as T
from capsonde.functions import vectors as V
from capsonde.functions.flatten import flatten_row, leaves_text


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_compact(spark):
    values = [None, "", "  a \t\n b　c ", "x" * 20, "abcdefg   hijklmnop"]
    assert apply(spark, values, lambda c: T.compact(c, 10)) == [
        "", "", "a b c", "xxxxxxx...", "abcdefg...",
    ]


def test_compact_trims_before_the_dots(spark):
    assert apply(spark, ["abcdef ghijk"], lambda c: T.compact(c, 10)) == ["abcdef..."]


def test_strip_matches_unicode_whitespace(spark):
    values = ["\x1c  a b \x85\xa0", "\n", "plain"]
    assert apply(spark, values, T.strip) == ["a b", "", "plain"]


def test_norm_name(spark):
    values = ["Multi-Step  Reasoning!", "__a__b__", "", None, "éè", "A1 b2"]
    assert apply(spark, values, T.norm_name) == [
        "multi_step_reasoning", "a_b", "unnamed_ability", "unnamed_ability", "unnamed_ability", "a1_b2",
    ]


def test_title_after_digits(spark):
    assert apply(spark, ["3d_a1b_rag2", "x_y"], T.title_of) == ["3D A1B Rag2", "X Y"]


REPLIES = [
    ('{"a": 1}', 1),
    ('```json\n{"a": 2}\n```', 2),
    ('```\n{"a": 3}```', 3),
    ('Sure: {"a": 4} done', 4),
    ('{"a": 5', None),
    ("no json", None),
    ("", None),
    (None, None),
    ('```json\n{"a": "x```y", "b": 6}\n```', None),
]


def test_parse_json_text(spark):
    got = apply(
        spark, [r for r, _ in REPLIES],
        lambda c: F.try_variant_get(T.parse_json_text(c), "$.a", "int"),
    )
    assert got == [a for _, a in REPLIES]


def test_parse_json_text_keeps_fences_inside_strings(spark):
    got = apply(
        spark, [REPLIES[-1][0]], lambda c: F.try_variant_get(T.parse_json_text(c), "$.a", "string")
    )
    assert got == ["x```y"]


def test_label_words(spark):
    assert apply(spark, ["Tool_use and the API-calls of API"], T.label_words, "string") == [
        ["tool", "use", "api", "calls", "api"]
    ]


def test_query_variants(spark):
    assert apply(spark, ["Big Bench (hard)", "GSM8K"], T.query_variants) == [
        ["Big Bench (hard)", "Big-Bench-(hard)", "Big Bench"], ["GSM8K"],
    ]


def test_head_tail(spark):
    words = " ".join(str(i) for i in range(30))
    out = apply(spark, [words, "short one"], lambda c: T.head_tail(c, 24, 4))
    assert out == [
        " ".join(map(str, range(10))) + "\n...\n" + " ".join(map(str, range(20, 30))), "short one",
    ]


def test_or_else(spark):
    df = spark.createDataFrame([("", None, "d"), ("a", "b", "d"), (None, "b", "d")], "x string, y string, z string")
    got = [r[0] for r in df.select(T.or_else(F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert got == ["d", "a", "b"]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.integers(0, 4000), min_size=400, max_size=400))
def test_round_binary_is_python_round(spark, halves):
    values = [h / 2000 for h in halves] + [h / 16 for h in range(17)] + [0.6505, 0.0625, 2.675, 1 / 3]
    got = apply(spark, values, lambda c: S.round_binary(c, 3), "double")
    assert got == [round(v, 3) for v in values]


def test_tier_limits(spark):
    assert apply(spark, [0.8, 0.799, 0.65, 0.649, None], S.tier, "double") == [
        "strong", "moderate", "moderate", "weak", "no-lobo",
    ]


def test_depth_layers(spark):
    # Published depths of models with 28, 36, 42, 43 and 64 layers; one and two by the rule.
    got = apply(spark, [28, 36, 42, 43, 64, 1, 2], S.depth_layers, "int")
    assert got == [
        [7, 14, 21, 28], [9, 18, 27, 36], [10, 21, 32, 42], [11, 22, 32, 43], [16, 32, 48, 64], [1], [1, 2],
    ]


def test_top_list(spark):
    df = spark.createDataFrame(
        [([("a", 3), ("b", 2)],), (None,)], "v array<struct<name:string,count:bigint>>"
    )
    got = [[tuple(x) for x in r[0]] for r in df.select(S.top_list(F.col("v"), 1)).collect()]
    assert got == [[("a", 3)], []]


ROWS = [
    {"q": "text", "n": 3, "b": True, "z": None, "l": ["a", 1, "", "b"]},
    {"m": [{"role": "user", "content": "hi"}, {"content": ["x", "y"]}, {"role": "system"}]},
    {"d": {"k": "v", "deep": {"x": "y", "deeper": {"lost": "1"}}, "n": 4}},
    {"long": [str(i) for i in range(12)], "nested": [[["a"], "b"], "c"]},
    {"wide": {str(i): "v" for i in range(12)}},
]


def test_flatten_rows(spark):
    got = apply(spark, [json.dumps(r) for r in ROWS], flatten_row)
    fields = [{f["key"]: f["text"] for f in row} for row in got]
    assert fields[0] == {"q": "text", "n": "", "b": "", "z": "", "l": "a\nb"}
    assert fields[1] == {"m": "user: hi\n: x\ny\nsystem: "}
    assert fields[2] == {"d": "k: v\ndeep: x: y"}
    assert fields[3] == {"long": "\n".join(map(str, range(8))), "nested": "a\nb\nc"}
    assert fields[4] == {"wide": "\n".join(f"{i}: v" for i in range(8))}
    assert [list(f) for f in fields[:1]] == [["q", "n", "b", "z", "l"]]


@pytest.mark.parametrize("value, text", [
    ({"a": {"b": {"c": "x"}}}, ""),
    ([{"a": {"b": "x"}}], ""),
    ([{"a": "x"}], "a: x"),
    ({"a": {"b": "", "c": "x", "d": "y"}, "e": 4, "f": "z"}, "a: c: x\nd: y\nf: z"),
    ({"a": {"role": "user"}, "b": [{"role": "u", "content": "v"}]}, "a: user: "),
    ([{"content": {"k": ["x", "y"]}}, {"role": None, "content": {"k": {"l": "m"}}}], ": \nNone: "),
    ({"m": [[["x"], []], [], "y"]}, "m: x\ny"),
    ([1, None, True, "x"], "x"),
])
def test_leaves_text(value, text):
    assert leaves_text(value) == text


def test_rows_that_are_no_objects_fail(spark):
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        apply(spark, ["{"], flatten_row)


def test_replies_with_repeated_keys_or_nan_are_rejected(spark):
    got = apply(spark, ['{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1}'], lambda c: T.parse_json_text(c).isNull())
    assert got == [True, True, False]


def test_stream_mean(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],)], "s array<array<float>>")
    assert df.select(V.stream_mean(F.col("s"))).first()[0] == [2.0, 4.0]


def test_unit_of_zero_is_finite(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "v array<double>")
    assert df.select(V.unit(F.col("v"))).first()[0] == [0.0, 0.0]


VALUES = st.lists(
    st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=30, max_size=30
)


@settings(max_examples=3, deadline=None)
@given(VALUES)
def test_value_bucket_is_monotone(spark, values):
    values = sorted(values)
    buckets = apply(spark, values, N.value_bucket, "double")
    assert buckets == sorted(buckets)


def test_row_number_by_equals_plain_numbering(spark):
    rows = [(g, i * 7919 % 1000) for g in ("a", "b") for i in range(700)]
    df = spark.createDataFrame(rows, "g string, pos bigint")
    got = N.row_number_by(df, ["g"], [F.col("pos")], N.position_bucket(F.col("pos"), 64))
    for g in ("a", "b"):
        want = {p: i + 1 for i, p in enumerate(sorted(p for h, p in rows if h == g))}
        assert {r["pos"]: r["rn"] for r in got.filter(F.col("g") == g).collect()} == want


def test_shard_of(spark):
    df = spark.createDataFrame([(p,) for p in (5, 900000, 17, 3, 400000)], "pos bigint")
    got = {r["pos"]: r["shard"] for r in N.shard_of(df, "pos", 2).collect()}
    assert got == {3: 0, 5: 1, 17: 0, 400000: 1, 900000: 0}


def test_average_rank_with_ties(spark):
    values = [0.0] * 5 + [-1.0, -1.0, 2.0, 1e9, -3.5]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = {r["v"]: (r["n_ties"], r["avg_rank"]) for r in N.average_rank(df, ["g"], "v").collect()}
    assert got == {-3.5: (1, 1.0), -1.0: (2, 2.5), 0.0: (5, 6.0), 2.0: (1, 9.0), 1e9: (1, 10.0)}


@pytest.mark.parametrize("seed", [0, 1])
def test_draw_key_depends_on_all_parts(spark, seed):
    df = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "b")], "x string, y string")
    keys = {r[0] for r in df.select(S.draw_key(seed, F.col("x"), F.col("y"))).collect()}
    assert len(keys) == 3

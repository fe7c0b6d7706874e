import math

import pytest
from pyspark.sql import functions as F

from stridelake.functions import actions as A
from stridelake.functions import text as T


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_bins_round_half_to_even_and_invert(spark):
    vals = [-2.0, -1.0, -0.5, 0.0, 0.25, 1.0, 3.0]
    got = one(spark, F.transform(F.array(*map(F.lit, vals)), lambda v: A.to_bin(v, 4)), F.transform(F.array(*map(F.lit, range(4))), lambda b: A.from_bin(b, 4)))
    assert got[0] == [0, 0, 1, 2, 2, 3, 3]
    assert [round(v, 9) for v in got[1]] == [-1.0, round(-1 / 3, 9), round(1 / 3, 9), 1.0]
    assert (A.token_width(9), A.token_width(11), A.token_width(256), A.token_width(1001)) == (2, 2, 3, 4)


@pytest.mark.parametrize("text,ok,want", [("<act_00><act_10> <act_05>", True, [-1.0, 1.0]), ("<act_00>", False, [0.0, 0.0]), ("<act_00><act_11>", False, [0.0, 0.0]), ("<act_0><act_5>", False, [0.0, 0.0]), ("", False, [0.0, 0.0]), ("<act_00><act_99999999999>", False, [0.0, 0.0])])
def test_bin_tokens_are_parsed(spark, text, ok, want):
    r = one(spark, A.parse_bin_tokens(F.lit(text), 2, 11).alias("p")).p
    assert (r.ok, r.action) == (ok, want)


@pytest.mark.parametrize("text,ok,want", [("go -35 , +72 now", True, [-0.35, 0.72]), ("1,2,3", True, [0.01, 0.02]), ("none", False, [0.0, 0.0]), ("5", False, [0.0, 0.0])])
def test_action_text_is_parsed(spark, text, ok, want):
    r = one(spark, A.parse_action(F.lit(text), 2).alias("p")).p
    assert (r.ok, r.action) == (ok, want)


def test_action_text(spark):
    assert one(spark, A.action_text(F.array(*map(F.lit, (0.125, -0.35, 2.0, -7.0)))))[0] == "12,-35,100,-100"
    r = one(spark, *(A.valid_action(F.array(*map(F.lit, a)), 2, 1e-4) for a in ((1.00005, 0.0), (1.1, 0.0), (math.nan, 0.0), (0.0, 0.0, 0.0))))
    assert list(r) == [True, False, False, False]


def test_soft_targets_and_softmax(spark):
    r = one(spark, A.soft_targets(F.lit(2), 5, 1.0), A.soft_targets(F.lit(2), 5, 1.0, 1), A.softmax(F.array(*map(F.lit, (1.0, 2.0, 1000.0)))), A.greedy_l1(F.array(*map(F.lit, (0.0, 5.0, 5.0))), F.lit(2), 3))
    assert abs(sum(r[0]) - 1) < 1e-12 and r[0][1] == r[0][3] and abs(r[0][2] / r[0][1] - math.exp(0.5)) < 1e-9
    assert r[1][0] == r[1][4] == 0 and abs(sum(r[1]) - 1) < 1e-12
    assert r[2] == [0.0, 0.0, 1.0] and r[3] == 1.0


def test_likelihoods(spark):
    t, g, edge = one(spark, A.student_t_nll(F.lit(0.3), F.lit(0.1), F.lit(-0.2), 4.0), A.squashed_gaussian_nll(F.lit(0.3), F.lit(0.1), F.lit(-0.2)), A.squashed_gaussian_nll(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    z = 0.2 / math.exp(-0.2)
    pdf = math.gamma(2.5) / (math.sqrt(4 * math.pi) * math.gamma(2)) * (1 + z * z / 4) ** -2.5 / math.exp(-0.2)
    assert abs(t + math.log(pdf)) < 1e-9
    u = (math.atanh(0.3) - 0.1) / math.exp(-0.2)
    assert abs(g - (0.5 * u * u - 0.2 + 0.5 * math.log(2 * math.pi) + math.log(1 - 0.09 + 1e-6))) < 1e-9
    assert math.isfinite(edge)


def test_templates():
    with pytest.raises(KeyError, match="missing"):
        T.render("{missing}", {})


def test_templates_and_tags(spark):
    r = one(spark, T.render("{{a}} {x}{y}!", {"x": F.lit(1), "y": F.lit("$1 \\ {z}")}), T.training_chat(F.lit("p"), F.lit("r")), T.generation_prompt(F.lit("p")))
    assert r[0] == "{a} 1$1 \\ {z}!" and r[1] == r[2] + "r</turn>"
    assert T.tag_order("abc", "bca", True) == ("b", "c", "a") and T.tag_order("abc", "", False) == ("a", "b", "c")
    for tags, order in (("aa", "aa"), ("ab", "ab"), ("ab", "ac"), ("a", "a"), ("ab", "b")):
        with pytest.raises(ValueError):
            T.tag_order(tags, order, True)


def arr(*v):
    return F.array(*map(F.lit, v)) if v else F.array().cast("array<int>")


@pytest.mark.parametrize("a,b,want", [((1, 2, 3, 2, 3), (2, 3), 1), ((1, 2), (2, 1), -1), ((1,), (1, 2), -1), ((1, 2), (), -1), ((), (1,), -1), ((5, 5, 5), (5, 5, 5), 0)])
def test_subsequences(spark, a, b, want):
    assert one(spark, T.find_sub(arr(*a), arr(*b)))[0] == want


def test_labels(spark):
    r = one(spark, T.masked_labels(arr(1, 2), arr(3, 4, 5), 4), T.bin_labels(arr(9, 7, 8, 7), arr(7, 8), arr(0, 1)), T.bin_labels(arr(9, 9), arr(7, 8), arr(0, 1)))
    assert list(r) == [[-100, -100, 3, 4], [-1, 0, 1, -1], [-1, -1]]
    q = one(spark, T.query_slots(arr(1, 2, 3), arr(10, 11, 12, 13), 2).alias("q")).q
    assert [(s.anchor, s.position, s.offset, s.target) for s in q] == [(2, 3, 0, 10), (2, 4, 1, 11), (4, 5, 0, 12), (4, 6, 1, 13)]


def test_collate(spark):
    df = spark.createDataFrame([(0, [1], [2]), (0, [1, 1, 1], [2, 2]), (1, [], [5])], "b int, ids array<int>, labels array<int>")
    got = sorted((r.b, r.ids, r.labels) for r in T.collate(df, "b", {"ids": 0, "labels": -100}).collect())
    assert got == [(0, [1, 0, 0], [2, -100]), (0, [1, 1, 1], [2, 2]), (1, [], [5])]


GRID = [[1, 1, 1, 1], [1, 0, 0, 1], [1, 1, 0, 1], [1, 1, 1, 1]]


@pytest.mark.parametrize("path,want", [("RD", (2, 2, False)), ("RR", (1, 2, True)), ("", (1, 1, False)), ("URD", (1, 1, True))])
def test_walks(spark, path, want):
    g = F.array(*(arr(*line) for line in GRID))
    moves = F.array(*map(F.lit, path)) if path else F.array().cast("array<string>")
    assert tuple(one(spark, T.walk(g, F.lit(1), F.lit(1), moves).alias("w")).w) == want


def test_moves(spark):
    r = one(spark, T.moves(F.lit(" path: u r ")), T.moves(F.lit("PATH: L PATH: stay")), T.moves(F.lit("uxd")), T.single_move(F.lit("up MOVE: d")), T.single_move(F.lit("?")))
    assert list(r) == [["U", "R"], [], ["U", "D"], "D", None]


def test_resource_text(spark):
    r = one(spark, T.meminfo(F.lit("MemTotal:  2 kB\nHugePages: 3\nodd\nBad: x kB\n")).alias("m"), T.gpu_lines(F.lit("0, GPU X, 10, 20, 5, 40, [N/A]\n\n")).alias("g"))
    assert r.m == {"MemTotal": 2048, "HugePages": 3}
    assert tuple(r.g[0]) == ("0", "GPU X", 10.0, 20.0, 5.0, 40.0, None)


def test_small_formats(spark):
    r = one(spark, T.percent(F.lit(0.12345)), T.signed_pp(F.lit(0.021)), T.signed_pp(F.lit(-0.021)), T.clamp01(F.lit(1.5)), T.range_penalty(F.lit(5.0), 1.0, 3.0), T.ceil_div(F.lit(7), 3), T.typed_name(F.lit("maze-dense-v2"), F.lit("sparse")), T.typed_name(F.lit("maze-v2"), F.lit("dense")))
    assert list(r) == ["12.3%", "+2.1 pp", "-2.1 pp", 1.0, 1.0, 3, "maze-sparse-v2", "maze-dense-v2"]

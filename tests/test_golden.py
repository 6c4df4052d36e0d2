"""Golden examples taken from the reference's documented examples."""

import math

from pyspark.sql import functions as F

from prefspark.functions import labels as LB
from prefspark.functions import text as TX
from prefspark.functions import vectors as V
from prefspark.operators import aggregate as G
from prefspark.operators import project as P
from prefspark.operators import window as W


def test_f13_ordinal_to_binary(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 2, 3, 4, 0])], "i int, x double")
    got = [r.b for r in df.select("i", LB.ordinal_to_binary(F.col("x")).alias("b")).orderBy("i").collect()]
    assert got == [1, 1, 2, 2, 0]


def test_f13_half_even(spark):
    df = spark.createDataFrame([(2.5,), (1.5,), (0.5,)], "x double")
    got = [r.b for r in df.select(LB.ordinal_to_binary(F.col("x")).alias("b")).collect()]
    # round half to even: 2.5 -> 2 -> 1, 1.5 -> 2 -> 1, 0.5 -> 0 -> 0
    assert got == [1, 1, 0]


def test_f12_swap(spark):
    df = spark.createDataFrame([("2+2", "3", "4", 2, True), ("2+3", "5", "4", 1, False)],
                               "instruction string, output_1 string, output_2 string, preference int, flag boolean")
    out = df.select(F.when(F.col("flag"), F.col("output_2")).otherwise(F.col("output_1")).alias("o1"),
                    F.when(F.col("flag"), F.col("output_1")).otherwise(F.col("output_2")).alias("o2"),
                    LB.swap_preference(F.col("preference"), F.col("flag")).alias("p")).collect()
    assert [(r.o1, r.o2, r.p) for r in out] == [("4", "3", 1), ("5", "4", 1)]


def test_f14_scan_matches(spark):
    text = "\n(b)\n\nverdict for pair 3:\n(a)\nnote (b) inline\n(b)"
    df = spark.createDataFrame([(text,), (" (a)",), (None,), ("",)], "t string")
    got = [r.k for r in df.select(LB.scan_matches(F.col("t"), {"1": r"\n\(a\)", "2": r"\n\(b\)"}).alias("k")).collect()]
    assert got == [["2", "1", "2"], [], [], []]
    assert df.select(LB.scan_matches(F.col("t"), {"1": r" \(a\)", "2": r" \(b\)"}).alias("k")).collect()[1].k == ["1"]


def test_f14_groups_and_inner_anchors(spark):
    df = spark.createDataFrame([("x(a) y(b)",), ("ab\nabab",)], "t string")
    got = [r.k for r in df.select(LB.scan_matches(F.col("t"), {"1": r"(x|z)\(a\)", "2": r"y\(b\)"}).alias("k")).collect()]
    assert got[0] == ["1", "2"]
    got = [r.k for r in df.select(LB.scan_matches(F.col("t"), {"1": r"(?:^|\n)ab"}).alias("k")).collect()]
    assert got[1] == ["1", "1", "1"]
    # the JVM and the Python path agree where both apply
    pats = {"p": r"(a)(b)?", "q": "y"}
    rows = df.select(LB._scan_plain(F.col("t"), pats).alias("j"), LB._scan_cut(F.col("t"), pats).alias("p")).collect()
    assert all(r.j == r.p for r in rows)


def test_f14_anchored_patterns_rematch_at_cut(spark):
    # '^' matches again after each cut: "ab" then "ab" -> two hits of key a; an unanchored
    # scan would find only the first one
    df = spark.createDataFrame([("abab",), ("xab",)], "t string")
    got = [r.k for r in df.select(LB.scan_matches(F.col("t"), {"a": "^ab", "x": "^x"}).alias("k")).collect()]
    assert got == [["a", "a"], ["x", "a"]]
    same = [r.k for r in df.select(LB._scan_cut(F.col("t"), {"1": "a", "2": "b"}).alias("k")).collect()]
    assert same == [["1", "2", "1", "2"], ["1", "2"]]


def test_f15_parse_judgement_count_check(spark):
    df = spark.createDataFrame([("\n(a)\n(b)",), ("\n(a)",)], "t string")
    got = df.select(LB.parse_judgement(F.col("t"), {"1": r"\n\(a\)", "2": r"\n\(b\)"}, 2).alias("k")).collect()
    assert got[0].k == ["1", "2"] and got[1].k is None


def test_w09_pack_batches(spark):
    df = spark.createDataFrame([(0, "solve", "1+1"), (1, "write backwards", "'abc'"), (2, "other 1", "")],
                               "row_id int, instruction string, input string")
    b = W.pack_batches(df, 2, "first: {instruction} {input}, second: {instruction} {input}",
                       ["instruction", "input"], order="row_id", dummy={"instruction": "pad", "input": "pad_in"})
    got = [r.prompt for r in b.orderBy("batch_no").collect()]
    assert got == ["first: solve 1+1, second: write backwards 'abc'", "first: other 1 , second: pad pad_in"]
    assert [r.n_padded for r in b.orderBy("batch_no").collect()] == [0, 1]


def test_f24_batch_select(spark):
    df = spark.createDataFrame([([0, 1, 2], [0, 1]), ([3, 0, 9], [1, 0]), ([6, 7, 8], [0, 0])],
                               "a array<int>, idx array<int>")
    got = [r.s for r in df.select(V.batch_select("a", "idx").alias("s")).collect()]
    assert got == [[0, 1], [0, 3], [6, 6]]


def test_w06_gae_golden(spark):
    df = spark.createDataFrame([([1.0, 0.0, 2.0], [0.5, 0.4, 0.3])], "rewards array<double>, values array<double>")
    adv = df.transform(lambda d: W.gae(d, 0.9, 0.95)).collect()[0].advantages
    for a, b in zip(adv, [1.9915925, 1.3235, 1.7]):
        assert abs(a - b) < 1e-9


def test_w04_persistent_cut(spark):
    df = spark.createDataFrame([(1, 0, "aaaa", "", "x"), (1, 1, "bbbb", "", "x"), (1, 2, "cccc", "", "x")],
                               "conv_id int, turn int, user_text string, chosen string, rejected string")
    h = W.dialog_history(df, 6, 0, 100).orderBy("turn").collect()
    assert [r.history for r in h] == ["aaaa", "aabbbb", "bbcccc"]


def test_w04_cut_persists(spark):
    # the cut of turn 1 persists: the history of turn 2 starts from the cut history
    df = spark.createDataFrame([(1, 0, "aaaa", "", "x"), (1, 1, "bbbbbb", "", "x"), (1, 2, "c", "", "x")],
                               "conv_id int, turn int, user_text string, chosen string, rejected string")
    h = W.dialog_history(df, 6, 0, 100).orderBy("turn").collect()
    assert [r.history for r in h] == ["aaaa", "bbbbbb", "bbbbbc"]


def test_p30_format_prompt(spark):
    df = spark.createDataFrame([("test", "")], "instruction string, input string")
    got = df.select(TX.format_prompt("with {instruction} {input}", "prompt {instruction} ").alias("p")).collect()
    assert got[0].p == "prompt test "


def test_p32_chatml(spark):
    prompt = ("<|im_start|>system\nYou are a helpful assistant.\n<|im_end|>\n<|im_start|>system "
              "name=example_user\nKnock knock.\n<|im_end|>\n<|im_start|>system name=example_assistant\nWho's "
              "there?\n<|im_end|>\n<|im_start|>user\nOrange.\n<|im_end|>")
    df = spark.createDataFrame([(prompt,)], "p string")
    m = df.select(TX.chatml_messages(F.col("p")).alias("m")).collect()[0].m
    assert [x.role for x in m] == ["system", "system", "system", "user"]
    assert [x.content for x in m] == ["You are a helpful assistant.", "Knock knock.", "Who's there?", "Orange."]
    assert m[1].attrs == {"name": "example_user"} and m[0].attrs is None


# Stored leaderboard counts of the reference (wins, base wins, draws) and its published rates.
LEADERBOARD = [
    (370, 424, 9, 46.63760896637609, 1.751619984513092),
    (320, 468, 16, 40.79601990049751, 1.7163543811890173),
    (201, 604, 0, 24.96894409937888, 1.5264851835334794),
    (489, 306, 9, 61.38059701492538, 1.707975918938111),
    (94, 692, 0, 11.959287531806616, 1.1581361013229673),
    (639, 149, 17, 80.43478260869566, 1.3753918376580683),
]


def test_g06_reproduces_leaderboard(spark):
    rows = []
    for m, (w, b, d, _, _) in enumerate(LEADERBOARD):
        rows += [(m, 2)] * w + [(m, 1)] * b + [(m, 0)] * d + [(m, 4)] * 3  # code 4 is dropped
    df = spark.createDataFrame(rows, "method int, preference int")
    got = {r.method: r for r in G.head2head_metrics(df, by=["method"]).collect()}
    for m, (w, b, d, rate, se) in enumerate(LEADERBOARD):
        assert got[m].n_total == w + b + d
        assert abs(got[m].win_rate - rate) < 1e-9 and abs(got[m].standard_error - se) < 1e-9
    cnt = spark.createDataFrame([(w, b, d) for w, b, d, _, _ in LEADERBOARD], "n_wins long, n_wins_base long, n_draws long")
    for r, (_, _, _, rate, se) in zip(G.metrics_from_counts(cnt).collect(), LEADERBOARD):
        assert abs(r.win_rate - rate) < 1e-9 and abs(r.standard_error - se) < 1e-9


def test_p11_second_segment_only(spark):
    df = spark.createDataFrame([("Human: hi Assistant:  a Assistant: b ",), ("no marker",)], "c string")
    got = [r.c for r in P.response_after_marker(df, "c").collect()]
    assert got == ["a", None]


def test_f01_stable(spark):
    df = spark.createDataFrame([(1000.0, 0.0), (0.0, 1000.0), (1.0, 1.0)], "a double, b double")
    got = [r.l for r in df.select(V.log_sigmoid_loss("a", "b").alias("l")).collect()]
    assert got[0] == 0.0 and abs(got[1] - 1000.0) < 1e-9 and abs(got[2] - math.log(2)) < 1e-12


def test_f14_references_by_number(spark):
    """Patterns keep their own group numbers, behind other patterns with groups, in sets and after escapes."""
    df = spark.createDataFrame([("aa bcc xbb [1] a1",), ("ab aa",), ("\\\\1 q",)], "t string")
    pats = {"twice": r"(a)\1", "other": r"b(c)\1", "third": r"(x)(b)\2", "set": r"[\[][1]\]", "cond": r"(q)?(?(1)!|z)"}
    got = [r.k for r in df.select(LB.scan_matches(F.col("t"), pats).alias("k")).collect()]
    assert got == [["twice", "other", "third", "set"], ["twice"], []]

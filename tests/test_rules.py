"""Decision tables of ordered rules."""

import itertools

import pytest
from pyspark.sql import functions as F

from talkmill.functions import judge, text
from talkmill.operators import decisions, pairs, rules


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*(c.alias(n) for n, c in columns.items())).collect()]


@pytest.mark.parametrize("length,reason", [(19, "text_length_out_of_range"), (20, None), (180, None), (220, None), (221, "text_length_out_of_range")])
def test_length_bounds(spark, length, reason):
    got = rules.mechanical_reason(F.col("t"), F.array().cast("array<string>"), ["danger"], "@", 20, 220, 5)
    assert values(spark, [("a" * length,)], "t string", r=got) == [(reason,)]


def test_crisis_skips_later_rules_but_not_missing_fields(spark):
    rows = [("danger " + "a." * 300, "x"), ("danger", ""), ("b" * 30 + "! " * 3 + "x@y", "x"), ("One two three four five! " * 6, "x")]
    got = rules.mechanical_reason(F.col("t"), rules.missing_columns(["s"]), ["danger"], "@", 20, 220, 5)
    assert [r[0] for r in values(spark, rows, "t string, s string", r=got)] == [None, "missing_fields:s", "non_student_or_prompt_marker", "sentence_count_out_of_range"]


def test_disposition_order(spark):
    rows = [tuple(x) for x in itertools.product((None, "r"), (True, False), (True, False), ("green", "red"), (True, False), (None, "d"))]
    where, why = rules.disposition(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("e"), F.col("f"))

    def plain(a, b, c, d, e, f):
        for test, name in ((a, "rejected"), (b, "quarantine"), (c, "quarantine"), (d != "green", "quarantine"), (e, "length_review"), (f, "duplicate")):
            if test:
                return name
        return "accepted"

    got = values(spark, rows, "a string, b boolean, c boolean, d string, e boolean, f string", w=where)
    assert [g[0] for g in got] == [plain(*r) for r in rows]


@pytest.mark.parametrize(
    "said,level,red,expected",
    [
        ("Hello!", "red", 0.9, "green"), ("I am tired", "yellow", 0.5, "green"), ("I will end my life tonight", "green", 0.0, "red"), ("I want to disappear", "red", 0.9, "yellow"),
        ("export MODE=1 make -f", "red", 0.9, "green"), ("grep -r\n\nmain.sh", "red", 0.9, "green"), ("grep -r main.sh", "red", 0.9, "red"), ("grep -r main.sh\n \n", "red", 0.9, "red"), ("grep -r main.sh | ssh ./a/b", "red", 0.9, "green"), ("so be it", "yellow", 0.1, "green"), ("what a clown", "red", 0.9, "yellow"), ("you moron", "red", 0.9, "yellow"), ("so be it", "red", 0.7, "yellow"), ("so be it", "red", 0.85, "red"),
    ],
)
def test_soft_rules(spark, said, level, red, expected):
    got = rules.soft_rules(F.lit(level), F.lit(0.0), F.col("p"), F.col("t"), rules.safety_signals(F.col("t")), 0.3, ["hello"], "^iamtired$")
    assert values(spark, [(said, red)], "t string, p double", r=got) == [(expected,)]


SAID = {
    "passive_death_ideation": "I want to  disappear", "active_suicide_ideation": "I will KILL myself", "self_harm_expression": "I hurt myself", "method_signal": "the pills", "time_signal": "tonight",
    "preparation_signal": "I made a plan", "bullying_context": "you moron", "idiom_expression": "what a clown", "negation_or_downgrade": "not really",
}


def test_marks_of_commands(spark):
    """By number, by lines and together, with the built-in table and with one's own."""
    rows = [("$ Grep -R\n./src/x",), ("$ grep -r ./src/x",), ("$ grep -r x",), ("$ grep -r\nx",), ("$ grep -r\n\n",), ("export A=1 make it -b",), ("export A=1 make it",), (None,), ("",)]
    assert [r[0] for r in values(spark, rows, "t string", r=rules.technical_text(F.col("t")))] == [True, True, False, True, False, True, False, False, False]
    own = rules.technical_text(F.col("t"), {"a": "a", "b": "b", "c": "c"}, ("a", "b"), 3)
    assert [r[0] for r in values(spark, [("ABC",), ("ab",), ("ac",), ("b\nc",), ("c",)], "t string", r=own)] == [True, True, False, True, False]
    alone = rules.technical_text(F.col("t"), {"a": "a", "b": "b"}, (), 2)
    assert [r[0] for r in values(spark, [("ab",), ("a",)], "t string", r=alone)] == [True, False]


def test_safety_signals_by_all_families(spark):
    """Every combination of the nine families, against the formulas in plain Python."""
    cases = [dict(zip(SAID, on)) for on in itertools.product((False, True), repeat=len(SAID))]
    rows = [(". ".join(SAID[k] for k in SAID if c[k]),) for c in cases]
    names = ("red_necessary", "risk_intent", "idiom", "bullying", "negated")
    signals = rules.safety_signals(F.col("t"))
    got = values(spark, rows, "t string", s=F.array_sort(signals["signals"]), **{n: signals[n] for n in names})
    for c, g in zip(cases, got):
        intent = c["active_suicide_ideation"] or c["passive_death_ideation"] or c["self_harm_expression"]
        concrete = c["method_signal"] or c["time_signal"] or c["preparation_signal"]
        red = (c["self_harm_expression"] and c["method_signal"]) or (intent and concrete and not c["negation_or_downgrade"])
        want = (red, intent, c["idiom_expression"] and not intent and not c["method_signal"], c["bullying_context"] and not intent and not concrete, c["passive_death_ideation"] and c["negation_or_downgrade"] and not concrete)
        assert g == (sorted(k for k in c if c[k]), *want), c


@pytest.mark.parametrize(
    "said,soft,strict",
    [
        ("I hurt myself with pills", "red", "red"), ("I hurt myself with pills, not really", "red", "red"), ("I want to disappear tonight", "red", "red"), ("I want to disappear, there is a bridge", "red", "red"),
        ("I will kill myself, I made a plan", "red", "red"), ("I will kill myself tonight, not really", "yellow", "yellow"), ("I will kill myself", "yellow", "yellow"), ("what a clown with pills", "red", "yellow"), ("you moron, tonight", "red", "yellow"),
        ("I want to disappear, not really", "yellow", "yellow"), ("you scum", "red", "yellow"),
    ],
)
def test_reds_by_signals(spark, said, soft, strict):
    signals = rules.safety_signals(F.col("t"))
    a = rules.soft_rules(F.lit("red"), F.lit(0.0), F.lit(0.9), F.col("t"), signals, 0.3)
    b = rules.policy_level(F.lit(0.0), F.lit(0.9), signals, F.lit(0.4), F.lit(0.6), F.lit("strict"))
    assert values(spark, [(said,)], "t string", a=a, b=b) == [(soft, strict)]


def test_caps_compose(spark):
    rows = [(["template_low_information", "adult_coaching_question"],), (["third_party_excuse", "hard_boundary_fabrication"],), ([],)]
    c = judge.cap_scores(F.lit(2), F.lit(2), F.lit(2), F.lit(False), F.lit(""), F.col("t"))
    assert values(spark, rows, "t array<string>", **c) == [(1, 1, 1, False, ""), (1, 0, 2, True, "hard_boundary_fabrication"), (2, 2, 2, False, "")]


@pytest.mark.parametrize("tag", ["template_low_information", "forced_positive_reframe", "unsupported_fact_completion", "hard_boundary_fabrication", "relationship_decision_risk"])
def test_five_tags_cap_er_and_ip(spark, tag):
    c = judge.cap_scores(F.lit(2), F.lit(2), F.lit(2), F.lit(False), F.lit(""), F.col("t"))
    assert [r[:3] for r in values(spark, [([tag],)], "t array<string>", **c)] == [(1, 1, 2)]


def test_ends_do_not_count_in_length(spark):
    got = rules.mechanical_reason(F.col("t"), F.array().cast("array<string>"), ["danger"], "@", 20, 220, 5)
    rows = [(" " * 10 + "a" * 15,), ("　" + "a" * 20 + "\n",), ("a" * 220 + "   ",), ("About 3.5 of 4.2. Well" + "!" * 5,)]
    assert [r[0] for r in values(spark, rows, "t string", r=got)] == ["text_length_out_of_range", None, None, None]
    assert values(spark, [("a" * 180 + " ",), ("a" * 181,), ("a" * 221,)], "t string", r=rules.needs_length_review(F.col("t"), 180, 220)) == [(False,), (True,), (False,)]


def test_punctuation_and_sentences(spark):
    rows = [("Ab, c d!",), ("ab",), ("3.5 is. one? two！",), ("", )]
    got = values(spark, rows, "t string", p=text.strip_punctuation(F.col("t")), n=text.sentence_count(F.col("t")))
    assert got == [("Abcd", 1), ("ab", 1), ("35isonetwo", 2), ("", 0)]


def test_tags_are_appended_once_and_read_back(spark):
    once = judge.append_tags(F.lit("why"), F.col("t"))
    got = values(spark, [(["a", "b"],), ([],)], "t array<string>", a=once, b=judge.append_tags(once, F.col("t")), c=judge.read_tags(once))
    assert got == [("why [audit_tags=a,b]", "why [audit_tags=a,b]", ["a", "b"]), ("why", "why", [])]


def test_score_policies(spark):
    rows = [("1",), ("2.7",), ("9",), ("-1",), ("high",), (None,), ("1.0",)]
    got = values(spark, rows, "r string", a=judge.score(F.col("r"), "strict"), b=judge.score(F.col("r"), "lenient"), c=judge.score(F.col("r"), "clamp"))
    assert got == [(1, 1, 1), (None, 2, 2), (None, 0, 2), (None, 0, 0), (None, 0, 0), (None, 0, 0), (None, 1, 1)]


def test_guidance_status(spark):
    rows = [(None,), ("{x",), ('{"status":"ready"}',), ('{"status":"odd"}',), ('{"status":"pending"}',)]
    assert [r[0] for r in values(spark, rows, "p string", s=rules.guidance_status(F.col("p")))] == ["missing", "failed", "ready", "missing", "pending"]


def test_order_swap_truth_table(spark):
    rows = [(i, "ab" if k == 0 else "ba", w) for i, (a, b) in enumerate(itertools.product(("A", "B", "tie", None), repeat=2)) for k, w in enumerate((a, b))]
    got = {r.k: r for r in pairs.order_stability(spark.createDataFrame(rows, "k int, display string, winner string"), ["k"]).collect()}
    swap = {"A": "B", "B": "A"}
    for i, (a, b) in enumerate(itertools.product(("A", "B", "tie", None), repeat=2)):
        second = swap.get(b, b)
        assert got[i].invalid == (a is None or b is None)
        assert got[i].stable == (a in ("A", "B") and a == second)


@pytest.mark.parametrize(
    "samples,winner,confidence",
    [("AAA", "A", "unanimous"), ("AAB", "A", "split_majority"), ("AA-", "A", "majority_with_unstable"), ("A--", None, "unstable"), ("AA!", None, "invalid"), ("AB", None, "unstable"), ("A-", "A", "majority_with_unstable")],
)
def test_majority(spark, samples, winner, confidence):
    rows = [(1, s if s in "AB" else None, s in "AB", s == "!") for s in samples]
    r = pairs.majority(spark.createDataFrame(rows, "k int, first string, stable boolean, invalid boolean"), "k").first()
    assert (r.winner, r.confidence) == (winner, confidence)


def test_empty_history_is_first_contact(spark):
    assert values(spark, [([],), (["x"],)], "h array<string>", s=decisions.stage(F.col("h"))) == [("first_contact",), ("follow_up",)]


def test_text_edges(spark):
    rows = [("",), ("ab",), ("abcd",), (None,)]
    got = values(spark, rows, "t string", g=text.char_ngrams(F.col("t"), 3), n=text.normalize_text(F.col("t")))
    assert got == [([], ""), (["ab"], "ab"), (["abc", "bcd"], "abcd"), (None, None)]
    assert values(spark, [("　A  b\xa0",)], "t string", n=text.normalize_text(F.col("t"))) == [("a b",)]


def test_segments(spark):
    said = "[a] first words here [a]again, quite long [b] short [c]another long one"
    got = values(spark, [(said,)], "t string", s=text.tag_sequence(F.col("t")), f=F.transform(text.select_fragments(text.tag_segments(F.col("t")), ["bad"]), lambda x: x["text"]))
    assert got == [(["a", "a", "b", "c"], ["first words here", "another long one"])]

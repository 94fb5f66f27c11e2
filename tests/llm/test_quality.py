import random

import pytest

from lodestrata.llm import quality
from lodestrata.llm.quality import _ARROW, measure, text_quality

PROSE = "We decided to keep the old index because nobody owned the follow-up. It took 38 minutes before the tests were green. They asked for a report, yet what they needed was a plan. If the cache is cold, we go back to release 1.2.3. "
rng = random.Random(1)
WORDS = "stale ranking model;missing map layer;regional scoring pass;central wiki compiler;noisy onboarding guide".split(";")
NOT_PROSE = {
    "bullets": "\n".join(f"- {rng.choice(WORDS)}" for _ in range(30)),
    "numbered": "\n".join(f"{i}. {rng.choice(WORDS)};" for i in range(30)),
    "commas": ", ".join(rng.choice(WORDS) for _ in range(60)),
    "fragments": "\n".join(f"from {rng.choice(WORDS)} to {rng.choice(WORDS)}." for _ in range(20)),
    "tabs": "\n".join(f"a{i}\t{i * 37}\t{i / 7:.2f}\tx" for i in range(30)),
    "pipes": "\n".join(f"| a{i} | {i * 37} | plan |" for i in range(30)),
    "columns": "\n".join(f"name{i}      {i * 37}        {i / 7:.2f}" for i in range(30)),
    "log": "\n".join(f"2025-08-02T20:35:{i:02d} INFO [export.bundle] rc={i} 1090b1e0" for i in range(30)),
    "trace": "\n".join(f"    at nigris.cleans(113ec:{i})" for i in range(30)),
    "json": '[{"id":"f23c","p":[6,5,2]},' + '{"id":"3b18","p":[7,2]},' * 20 + "]",
    "base64": "YBUo4DL22dCaz2fnsmpGy+Pn5u4D8NGmLyUNUsfGcF5b/Orj3w2xfKfxncfMSLZnqKl6olHw" * 8,
    "menu": " » ".join(rng.choice(["Home", "Next", "Skip to content", "Back to top", "Login"]) for _ in range(60)),
    "spaced": " ".join(PROSE.replace(" ", "")[:300]),
    "gibberish": " ".join("".join(rng.choice("qwrtzpsdfgjk") for _ in range(7)) for _ in range(60)),
    "repeated": "Careful: release 4.8.5 confirms the recall lane when the cache is cold. " * 30,
    "symbols": "=" * 300 + "\n" + "*" * 200,
    "mostly list": PROSE + "\n" + "\n".join(f"- {rng.choice(WORDS)}" for _ in range(60)),
}


NOT_PROSE["out of order"] = " ".join(random.Random(4).sample((PROSE * 3).replace("an", "the").split() + ["the", "of", "a", "with"] * 6, 120))


@pytest.mark.parametrize("kind", NOT_PROSE)
def test_not_prose(kind):
    assert measure(NOT_PROSE[kind])[-1], kind


@pytest.mark.parametrize(
    "text",
    [PROSE, PROSE.upper(), PROSE.lower().replace(".", ""), PROSE.replace(" ", "\n", 6), "# Notes\n\nHi all,\n\n" + PROSE + "\n\n- a point\n- another point", "[mind-rawturn conv:1 turn:0 speaker:user]\n" + PROSE, "Ich lese den Entwurf morgens, weil niemand den Plan kennt.", None, "", " \r\n ", "​"],
)
def test_prose_and_nothing(text):
    assert measure(text)[-1] == []


def test_statistics():
    got = dict(zip(_ARROW.names, measure("- One two.\nThe word is here")))
    assert got["n_words"] == 7 and got["bullet_line_share"] == 0.5 and got["closed_line_share"] == 0.5 and got["n_chars"] == 27
    assert abs(got["mean_word_length"] - 21 / 7) < 0.2 and 0 < got["common_word_share"] < 1


def test_table(spark):
    df = spark.createDataFrame([(1, PROSE), (1, PROSE), (2, None), (None, NOT_PROSE["tabs"]), (3, PROSE * 2000)], "doc_id long, text string").selectExpr("*", "1 AS reasons", "2 AS n_chars")
    got = text_quality(df, "doc_id", "text").collect()
    assert [bool(r.reasons) for r in got] == [False, False, False, True, True]
    assert text_quality(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_texts_counted_together_come_out_as_alone():
    texts = [PROSE, None, *NOT_PROSE.values(), "", PROSE.replace(". ", ".\r\n"), "É" * 30, "😀 " * 40, PROSE * 50]
    together = list(zip(*quality._measured(texts)))
    assert together == [measure(t) for t in texts]

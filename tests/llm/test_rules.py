import re

from gondola.llm import rules
from tests.llm.frames import ROWS, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 3000 else None
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), None if covered is None else len(covered)


CASES = [
    "a a a a a",
    "a b c a b c x",
    "x y\nx y\n \nx y \n",
    "one two three four one two three five one two",
    "## $5 & <b> \U0001f600 ñandú",
    "the end of the line " * 20,
    "plain words of the kind that are in a text that someone wrote " * 3 + "and some more of it",
]


def test_counts_equal_plain_python(spark):
    rows = [*ROWS, *((20 + i, t, "en", "a") for i, t in enumerate(CASES))]
    got = rules.judged(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted(((r[0], *plain(r[1])) for r in rows), key=repr)
    for g, w in zip(sorted(((r["doc_id"], *(r[c] for c in rules.COUNTS)) for r in got), key=repr), want):
        assert g[:5] == w[:5] and (w[5] is None or g[5] == w[5])
    for r in got:
        base = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == base and (not base or not r["kept"]) and r["kept"] == (r["failed"] is None)


def test_a_repeat_in_a_long_text(spark):
    words = [f"w{i}" for i in range(60_000)]
    words[50_000:50_004] = words[10:14]
    row = rules.judged(documents(spark, [(1, " ".join(words), "en", "a")])).first()
    assert row["n_words"] == 60_000 and row["n_repeat_words"] == 8 and not row["base_failed"]


def test_each_rule_of_the_table(spark):
    good = "the house of the man is in the old town and it was built for him. "
    body = " ".join(f"{w}{i}" if w not in rules.STOP_WORDS else w for i in range(6) for w in good.split())
    texts = {
        None: body,
        "word_length": " ".join(f"{'y' * 30}{i}" for i in range(60)),
        "symbols": " ".join(w + "#" * w[-1].isdigit() for w in body.split()),
        "letters": body + " " + " ".join(str(i) for i in range(90)),
        "stop_words": " ".join(f"word{i}" for i in range(90)),
        "same_lines": "\n".join([body, *["end"] * 4]),
        "bullet_lines": "\n".join(f"- the item{i} of number{i} and" for i in range(30)),
        "open_lines": "\n".join(f"the item{i} of number{i} ..." for i in range(30)),
    }
    got = {r["doc_id"]: r["failed"] for r in rules.judged(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts.values())])).collect()}
    assert list(got[i] for i in range(len(texts))) == list(texts)
    assert {k for k in texts if k} == {r[0] for r in rules.RULES}


def test_empty_table(spark):
    assert rules.judged(documents(spark, [])).collect() == []


def test_no_python_and_no_shuffle(spark):
    plan = rules.judged(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

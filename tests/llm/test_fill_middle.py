"""Fill-in-the-middle against a plain version, and exact round trips."""

import collections
import hashlib
import random
import re

import pytest

from sluice.llm import fill_middle

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t\n\v\f\r]*[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+", "char": r"(?s)."}
TEXTS = ["", None, "a", "\n", "\n\n\n", "a\n\nb", "a\nb\n", "ä\r\n日本\n\n😀 x", " lead\n tail ", "has <S> mark\nx\n", "<\n<P\nP>\n", "x " * 3000, "\n".join(f"line {i}" for i in range(5000)), "z" * 300_000, " \x85\n\v\f"]


def plain(text, key, unit, spm=50):
    text = text or ""
    units = re.findall(PATTERNS[unit], text)
    digits = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < spm
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", list(PATTERNS))
def test_against_plain(spark, unit):
    rows = [(k, t, "x", 0) for k in (1, 2, 3, 7, 7, None) for t in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n long").repartition(4)
    got = fill_middle.transform(df, unit=unit)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter((k, *plain(t, k, unit)) for k, t, _, _ in rows)
    back = collections.Counter(map(tuple, fill_middle.restore(got).collect()))
    assert back == collections.Counter((k, t or "") for k, t, _, _ in rows)
    assert fill_middle.transform(df.limit(0), unit=unit).collect() == []


def test_random_texts():
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice("ab\n \n<PSM>é") for _ in range(r.randint(0, 40)))
        unit, key = r.choice(list(PATTERNS)), r.randint(0, 10**6)
        output, *rest = fill_middle.rearrange(text, key, unit)
        assert (*rest, output) == plain(text, key, unit)
        assert fill_middle.restored(output, rest[1]) == text


def test_digests_rate_and_marks(spark):
    df = spark.createDataFrame([(i, f"Line {i}\nb\nc") for i in range(400)], "doc_id long, text string")
    whole = {r.doc_id: r for r in fill_middle.transform(df).collect()}
    for r in fill_middle.transform(df, as_text=False).collect():
        assert r.output_sha256 == hashlib.sha256(whole[r.doc_id].output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(f"Line {r.doc_id}\nb\nc".encode()).hexdigest()
    plain_ones = sum(r.form == "plain" for r in fill_middle.transform(df, rate=30).collect())
    assert 220 < plain_ones < 340
    with pytest.raises(ValueError):
        fill_middle.transform(df, marks=("<P>", "<P", "><"))
    with pytest.raises(ValueError):
        fill_middle.transform(df, unit="page")

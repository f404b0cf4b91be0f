"""Document fingerprints: walks against a step-by-step account, edits, neighbours, near groups."""

import hashlib
import random

import numpy as np
import pytest

from tablewright.llm import edit_fingerprint as ef
from tablewright.llm import queries

SF = "/root/testdata/sf0.001"


def written(text, walk):
    """The walk step by step: (character place, character) at every step."""
    stay = ef._tables()[0]
    out, i = [], 0
    while i < len(text):
        c = ord(text[i])
        out.append((i, c))
        here = int(stay[(len(out) - 1) % ef.PERIOD, (c ^ (c >> 8) * 157) % 32, walk])
        out += [(i, c)] * (here - 1)
        i += 1
    return out


def plain_fingerprint(text):
    falls, out = ef._tables()[2], []
    for s in range(ef.BYTES):
        symbols = written(text, s // ef.SAMPLES)
        if not symbols:
            out.append(0)
            continue
        at = max(int(p) for p in falls[s] if p < len(symbols))
        mixed = ef.mix64(np.array([at], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(symbols[at][1]) + np.uint64(1))
        out.append(int(mixed[0]) & 255)
    return bytes(out)


TEXTS = ["", "a", "aa", "hello world", "é中😀\n" * 7, "x" * 300, "the quick brown fox " * 40, "a", "", "\x00\x00"]


@pytest.mark.parametrize("mark, cells", [(32, 1 << 18), (4, 64), (2, 1)])
def test_walks_equal_the_plain_account(monkeypatch, mark, cells):
    monkeypatch.setattr(ef, "_MARK", mark)
    monkeypatch.setattr(ef, "_CELLS", cells)
    with np.errstate(over="ignore"):
        assert [f.tobytes() for f in ef.fingerprints(TEXTS)] == [plain_fingerprint(t) for t in TEXTS]


def _prose(r, n):
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9))) for _ in range(300)]
    return " ".join(r.choice(words) for _ in range(n))


def test_edits_stay_near_and_strangers_far():
    r, near, half, far = random.Random(2), [], [], []
    for _ in range(30):
        a, b = _prose(r, 400), _prose(r, 400)
        at = r.randrange(len(a) * 3 // 4, len(a))
        f = ef.fingerprints([a, a[:at] + r.choice("xyz") + a[at + r.randint(0, 2):], ef.edited(a, b), b])
        near.append(ef.likeness(f[0], f[1]))
        half.append(ef.likeness(f[0], f[2]))
        far.append(ef.likeness(f[0], f[3]))
    assert np.mean(near) > .75 and .4 < np.mean(half) < .65 and min(half) > max(far) and np.mean(far) < .15


def neighbours(data):
    """Contract rows by plain Python for unique ids."""
    rows = sorted(((d, t or "") for d, t in data), key=lambda x: (x[0] is not None, x[0] or 0))
    out = []
    for (d, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        e = ef.edited(t, u)
        f, g, h = ef.fingerprints([t, e, u])
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), f.tobytes().hex(), g.tobytes().hex(), float((f == g).mean()), float((f == h).mean())))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _got(df):
    return sorted(([(bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v) for v in r] for r in df.select(*COLUMNS).collect()), key=str)


def test_query_equals_the_account(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = _got(queries.QUERIES["op12_document_fingerprints"](spark, SF))
    assert got == [list(r) for r in neighbours(data)]


ODD = [(1, "a b c"), (2, None), (3, ""), (5, "x " * 30_000), (6, "one"), (None, "no id"), (9, "é 中 😀\x0b\n"), (-4, "a b c d")]


def test_odd_rows_and_extra_columns(spark):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in ODD], "doc_id long, text string, part string, kind int, fingerprint int").repartition(4)
    assert _got(ef.edited_neighbours(df)) == [list(r) for r in neighbours(ODD)]
    assert ef.fingerprint_report(df).count() == len(ODD)


@pytest.mark.parametrize("data", [[], [(7, "alone at home")], [(7, None)]])
def test_tiny_tables(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert _got(ef.edited_neighbours(df)) == [list(r) for r in neighbours(data)]
    assert ef.fingerprint_report(df).count() == len(data)


def test_repeated_ids_are_rows(spark):
    df = spark.createDataFrame([(1, "same old text")] * 500 + [(1, "other"), (None, "same old text")], "doc_id long, text string").repartition(5)
    got = ef.fingerprint_report(df).toPandas()
    assert len(got) == 502 and (got["near_next"] == 1).sum() >= 499 and got.groupby("fingerprint")["near_id"].nunique().max() == 1


def test_near_groups(spark):
    """Copies with a changed end form one group; strangers and the same start with another rest do not join it."""
    r = random.Random(4)
    base, head = _prose(r, 300), _prose(r, 30)
    data = [(i, base[:-i] if i else base) for i in range(40)] + [(100 + i, head + _prose(r, 300)) for i in range(40)] + [(200, base), (None, base)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.near_id for x in ef.fingerprint_report(df).collect()}
    assert all(got[i] == 0 for i in [*range(40), 200, None]) and all(got[100 + i] == 100 + i for i in range(40))


def _near_ids(prints, least):
    """Smallest id of the group of every id, by all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and root[i] != root[j] and sum(x == y for x, y in zip(prints[i], prints[j])) >= least * ef.BYTES:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    return root


def _changed(r, print_, places):
    return bytes((b + r.randint(1, 255)) % 256 if i in places else b for i, b in enumerate(print_))


@pytest.mark.parametrize("block", [1 << 15, 50])
def test_near_classes_equal_all_pairs(spark, monkeypatch, block):
    """Pairs just at the threshold that share no band, and chains whose ends are not near, are linked; those just below are not."""
    monkeypatch.setattr(ef, "_MOST_BLOCK", block)
    monkeypatch.setattr(ef, "_LEAST_BLOCK", 1)
    r, prints = random.Random(6), {}
    for i in range(0, 60, 3):
        prints[i] = r.randbytes(ef.BYTES)
        prints[i + 1] = _changed(r, prints[i], {*range(0, 128, 8), *r.sample([p for p in range(128) if p % 8], 35)})
        prints[i + 2] = _changed(r, prints[i + 1], set(r.sample(range(128), 51 + i % 2)))
    hot = r.randbytes(ef.BYTES)
    for i in range(100, 140):                              # a shared band whose smallest class is not near the others
        prints[i] = hot[:8] + (r.randbytes(120) if i == 100 else _changed(r, hot, set(r.sample(range(8, 128), 20)))[8:])
    rows = spark.createDataFrame(list(prints.items()), "doc_id long, fingerprint binary").repartition(3)
    want = _near_ids(prints, 0.6)
    assert {x.class_id: x.near_id for x in ef.near_classes(rows).collect()} == want
    assert want[1] == 0 and want[2] == 0 and want[139] == 101

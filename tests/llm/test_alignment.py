"""Cross-tokenizer alignment against a plain walk over both sequences."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from visret.llm import token_align
from visret.llm.common import read

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  a  b ", "a　b", "ﬁx", "a\n\nb", "▁x", "<s> a </s><0x41> <|endoftext|>", "é", "\x00a", " \n x \t y", "ü " * 3, "x" * 200 + " y",
       "日本語 \U0001f642", "don't 'll  we're 'S", "a  b", "a​ b c", "word " * 2000, "word " * 2000]


def walked(texts):
    """Rows and the counts of pairs, token by token."""
    tok = token_align.tokenizers(token_align.BYTES, token_align.PIECES)
    rows, counts = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        sides = [tok.a.encode(" " + text, add_special_tokens=False).ids, tok.b.encode(text)] if text else [[], []]
        spelt = [[tok.bytes_a[i] for i in sides[0]], [tok.bytes_b[i] for i in sides[1]]]
        if any(b"".join(x) != raw for x in spelt):
            sides = [[], []]
        ends = [list(np.cumsum([len(s) for s in x], dtype=int)) if side else [] for x, side in zip(spelt, sides, strict=True)]
        groups, at = [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            own = []
            for k in range(2):
                n = ends[k].index(e) + 1
                own.append(sides[k][at[k]:n])
                at[k] = n
            groups.append(own)
        links = Counter((a[-1], b[-1]) for a, b in groups)
        counts += links
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        rows.append((len(sides[0]), len(sides[1]), len(groups), links, hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(na, nb, ng, sum(x.values()), sum(n for p, n in x.items() if counts[p] == most[p[1]]), sum(n * counts[p] for p, n in x.items()), sha) for na, nb, ng, x, sha in rows]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_documents_equal_a_walk(spark):
    docs = sorted(read(spark, SF, "documents").select("doc_id", "text").collect())
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in token_align.digest(read(spark, SF, "documents")).collect()}
    assert got == {d.doc_id: w for d, w in zip(docs, walked([d.text for d in docs]), strict=True)}


def test_odd_texts_equal_a_walk_and_clashing_columns_do_no_harm(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id int, text string, pairs int, sums string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in token_align.digest(df).collect()}
    assert got == dict(enumerate(walked(ODD)))
    assert got[0] == got[1] == got[7] == (0, 0, 0, 0, 0, 0, "")
    assert token_align.digest(df.limit(0)).count() == 0


def test_counts_in_several_blocks_are_the_same(spark, tmp_path):
    token_align.align(read(spark, SF, "documents")).write.parquet(str(tmp_path / "a"))
    rows = spark.read.parquet(str(tmp_path / "a"))
    counts = token_align.pair_counts(rows)
    one, more = (sorted(map(tuple, token_align.with_counts(rows, counts, most).select("doc_id", "n_best", "count_sum").collect())) for most in (1 << 30, counts.count() // 3))
    assert one == more


@pytest.mark.parametrize("size", [1, 2, 700])
def test_long_texts_are_encoded_in_parts(spark, monkeypatch, size):
    monkeypatch.setattr(token_align, "TOGETHER", size)
    tok = token_align.tokenizers(token_align.BYTES, token_align.PIECES)
    texts = [t for t in ODD if t] + [r.text for r in read(spark, SF, "documents").limit(20).collect() if r.text]
    for t in texts:
        a, b = tok.ids(t)
        if a:
            assert np.frombuffer(a, "<u4").tolist() == tok.a.encode(" " + t, add_special_tokens=False).ids
            assert np.frombuffer(b, "<u4").tolist() == tok.b.encode(t)


def test_pointer_jumping_finds_components():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        ends = [np.array(sorted({*rng.choice(n, int(rng.integers(0, n)), replace=False).tolist(), n - 1})) + 1 for _ in range(2)]
        a, b, last_a, last_b = token_align.groups_of(*ends)
        both = np.intersect1d(*ends)
        assert a.tolist() == np.searchsorted(both, ends[0]).tolist() and b.tolist() == np.searchsorted(both, ends[1]).tolist()
        assert ends[0][last_a].tolist() == both.tolist() == ends[1][last_b].tolist()

"""Models, packing, token scans, urls and pages: held-out accuracy, round trips, brute force and
odd rows."""

import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from visret.llm import html_text, lang_id, packing, quality, token_scan, tokens, url_filter
from visret.llm.common import read

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, guess string, score string"
ODD = [(1, None, "en"), (2, "", None), (3, "123 ...", "en"), (3, "123 ...", "en"), (None, "the and of", "en"), (4, "Ünd die der " * 30_000, "de"), (5, "x", None)]


def odd(spark):
    return spark.createDataFrame([(i, t, lang, "clash", "clash") for i, t, lang in ODD], DOCS)


def remainder(doc, mod):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % mod


def test_language_of_held_out_documents(spark):
    d = read(spark, SF, "documents")
    rows = lang_id.predict(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert {r.doc_id for r in out} == {r.doc_id for r in rows if remainder(r.doc_id, 5) == 0}
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    got = lang_id.predict(odd(spark)).collect()
    assert len(got) == len(ODD)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(r.lang_pred in ("en", "de") for r in got if r.doc_id in (4, 5, None))
    kept = lang_id.keep(odd(spark))
    assert kept.columns == odd(spark).columns and 4 in {r.doc_id for r in kept.collect()}
    assert lang_id.predict(odd(spark).limit(0)).count() == 0
    nothing = lang_id.predict(odd(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_languages_equal_brute_force(spark):
    """Sizes taken one text at a time with dictionaries of the same passages."""
    import zstandard

    d = read(spark, SF, "documents")
    learned = sorted(lang_id.dictionaries(d.where(~lang_id.held_out("doc_id", 5, 0))).items())
    assert [n for n, _ in learned] == sorted({r.lang for r in d.select("lang").distinct().collect()})
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.predict(d).collect()}
    level = lang_id.LEVEL
    coders = [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                       write_content_size=False, write_dict_id=False) for _, raw in learned]
    for r in d.where("doc_id % 7 = 0").collect():
        raw = b" ".join("".join(c if "a" <= c <= "z" or c > "\x7f" else " " for c in r.text.lower()).encode().split())
        size = [max(1, sum(len(c.compress(b" " + raw[i:i + lang_id.BLOCK] + b" " + lang_id.TAIL)) - len(c.compress(b" " + lang_id.TAIL))
                           for i in range(0, len(raw), lang_id.BLOCK))) for c in coders]
        low, next_ = sorted(size)[:2]
        want = (learned[size.index(low)][0], 1 - low / next_) if any(map(str.isalpha, r.text)) else ("und", 0.0)
        assert got[r.doc_id] == want


def test_language_scores_mean_the_same_at_every_length(spark):
    """No jump where a text grows by a word, from a few bytes to beyond a block."""
    d = read(spark, SF, "documents")
    words = " ".join(r.text for r in d.where("lang = 'fr' and doc_id % 5 = 3").limit(60).collect()).split()
    rows = [(n, " ".join(words[:n]), None) for n in [*range(60, 160), 2000, 5000, 5001, len(words)]]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    guess = lang_id.guesser(made, lang_id.dictionaries(d))
    got = {r.doc_id: r.g for r in made.select("doc_id", guess(F.col("text")).alias("g")).collect()}
    assert {g.lang for g in got.values()} == {"fr"}
    assert all(abs(got[n].score - got[n + 1].score) < 0.05 for n in range(60, 159)) and min(g.score for g in got.values()) > 0.05


def test_every_part_of_a_text_can_teach(spark):
    """Passages beyond the first are drawn too, and copies leave room for other texts."""
    rows = [(1, "aaa " * 512 + "zebra " * 3000, "en")] + [(10 + i, "copy of one text", "en") for i in range(5000)] + [(9000 + i, f"text {i} ends", "en") for i in range(50)]
    raw = lang_id.dictionaries(spark.createDataFrame(rows, DOCS.split(", found")[0].split(", guess")[0]))["en"]
    assert b"zebra" in raw and raw.count(b"copy of one text") == 1 and raw.count(b"ends") > 20


def test_language_is_learned_from_training_rows_only(spark):
    """Held-out labels never count: with all of them wrong, predictions stay the same."""
    d = read(spark, SF, "documents")
    lied = d.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 'zz' else lang end as lang")
    assert sorted(map(tuple, lang_id.predict(d).collect())) == sorted(map(tuple, lang_id.predict(lied).collect()))


def test_quality_of_held_out_documents(spark):
    d, marks = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    rows = quality.predict(d, marks).join(marks, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert np.mean([r.quality == r.predicted for r in out]) > 0.97
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 and r.held_out == (remainder(r.doc_id, 3) == 1) for r in rows)


def test_quality_of_odd_rows(spark):
    marks = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 0), (4, None), (5, 7), (None, 1), (6, 1)], "doc_id long, quality int")
    assert quality.predict(odd(spark), marks).count() == len(ODD)
    kept = quality.keep(odd(spark), marks)
    assert kept.columns == odd(spark).columns
    assert {r.score for r in quality.predict(odd(spark), marks.limit(0)).collect()} == {0.5}
    assert quality.predict(odd(spark).limit(0), marks).count() == 0


def test_distinct_features_are_those_of_a_set():
    text = b"The the cat. THE!! cat. cat. cat. x9 9 \xc3\xa9t\xc3\xa9 *** cat."
    assert set(quality.Distinct()(text)) == set(quality.buckets(text)) and len(quality.Distinct()(text)) == len(set(quality.buckets(text)))


def test_counts_and_sample_equal_brute_force(spark):
    """Of a few labelled rows too: no feature is too rare, and every row is counted."""
    rows = [(i, ["good words here", "BAD BAD BAD!!", None, "good again, and again"][i % 4] + f" {i}" if i % 4 != 2 else None, [1, 0, 0, 1][i % 4]) for i in range(40)]
    found = quality.scanned(spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(3), [0.5, 1.0])
    n, seen = quality.class_counts(found)
    for c in (0, 1):
        own = [set(quality.buckets((t or "").encode()).tolist()) for _, t, y in rows if y == c]
        assert n[c] == len(own)
        count = np.zeros(quality.BUCKETS)
        for f in own:
            count[list(f)] += 1
        assert (seen[c] == count).all()
    features, y = quality.sampled(found, 1000, 1 << 20)
    assert (y == 1).sum() == 20 and 0 < (y == 0).sum() < 20
    some = quality.sampled(found, 1000, 8 * 60)[0]
    assert 0 < len(some) < len(features) and all(4 * sum(map(len, s)) <= 8 * 60 for s in [some])


def test_model_equals_a_plain_one(spark):
    """Log-count ratios, hinge loss and scores against a slow fit of the same problem, of six rows."""
    good, bad = ["The river was calm today.", "A calm evening by the river.", "They walked home slowly."], ["BUY NOW!!! cheap", "cheap cheap deals!!!", "CLICK here 99"]
    d = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 3)) for i in range(6)], "doc_id long, quality int")
    w, slope, offset = quality.fit(d, marks)
    sets = [sorted(set(quality.buckets(t.encode()).tolist())) for t in good + bad]
    used = sorted({f for s in sets for f in s})
    ratio = {f: np.log((sum(f in s for s in sets[:3]) + quality.SMOOTH) / (sum(f in s for s in sets[3:]) + quality.SMOOTH)) for f in used}
    x = np.array([[ratio[f] / np.sqrt(len(s)) if f in s else 0.0 for f in used] + [1.0] for s in sets])
    y = np.array([1, 1, 1, -1, -1, -1])

    def loss(v):
        return v @ v / 2 + np.maximum(0, 1 - y * (x @ v)).sum()

    plain = np.zeros(x.shape[1])
    for t in range(20000):
        plain -= (plain - x.T @ (y * (y * (x @ plain) < 1))) / (t + 10)
    own = np.array([w[f] / ratio[f] if ratio[f] else 0.0 for f in used] + [w[-1]])
    assert loss(own) <= 1.02 * loss(plain)
    margin = [sum(w[f] for f in s) / np.sqrt(len(s)) + w[-1] for s in sets]
    got = [r.s for r in d.select(quality.scorer(d, (w, slope, offset))(F.col("text")).alias("s")).collect()]
    assert np.allclose(got, [1 / (1 + np.exp(-(slope * m + offset))) for m in margin]) and min(got[:3]) > max(got[3:])


STRANGE = ["", " ", "don't WE'LL", "a<|endoftext|>b <|endoftext|>", "ΣΑΣ Σ. e\u0301 ý \u2003 x\u00a0y", "İ ﬁ ３ ½ 가\x1c\x1fq\x85r", "naïve Straße ÀÉ×÷ ŉ Ÿ", "1234 ,,, --- a1b2", "x" * 5000]


def test_remembered_ids_are_the_tokenizers():
    plain = Tokenizer.from_file(tokens.WORDS)
    for text, ids in zip(STRANGE, tokens.WordTokenizer(tokens.WORDS).ids([t.encode() for t in STRANGE]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_tokenizers_of_another_kind_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, made = Tokenizer.from_file(path), tokens.WordTokenizer(path)
    assert not made.by_stretch
    for text, ids in zip(STRANGE, made.ids([t.encode() for t in STRANGE]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def check_packed(rows, texts, max_tokens, max_segments):
    plain, sequences = Tokenizer.from_file(tokens.WORDS), {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == max_tokens or at & (at - 1) == 0
        assert at <= max_tokens and len(pieces) <= max_segments
    for doc, text in texts.items():
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at:at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


@pytest.mark.parametrize("segments", [512, 2])
def test_packing_is_an_exact_cover(spark, segments):
    d = read(spark, SF, "documents").select("doc_id", "text").limit(250)
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([None, *STRANGE, "word " * 20_000])], "doc_id long, text string")
    d = d.unionByName(extra).repartition(3).cache()
    check_packed(packing.pack_texts(d, max_segments=segments).collect(), {r.doc_id: r.text for r in d.collect()}, 4096, segments)
    assert packing.digest(d.limit(0)).count() == 0
    twice = packing.digest(odd(spark)).where("doc_id = 3").collect()  # a row that stands twice
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens


def test_examples_keep_all_limits(spark):
    rng = np.random.default_rng(0)
    e = [(i, int(rng.integers(1, 900)), 0) for i in range(3000)]
    e = [(i, n, int(rng.integers(0, n + 1))) for i, n, _ in e] + [(1, 50, 5), (9000, 2000, 1), (9001, None, 1), (9002, 10, 999), (None, 5, 5), (9003, -1, 0)]
    rows = packing.pack_examples(spark.createDataFrame(e, "id long, n_tokens long, n_loss long").repartition(2), max_tokens=1024, max_segments=5, max_loss=600).collect()
    assert len(rows) == len(e)
    assert {r.id for r in rows if r.sequence_id is None} == {9000, 9001, 9003} | {i for i, n, loss in e if n and loss > 600}
    bins = {}
    for r in rows:
        if r.sequence_id is not None:
            bins.setdefault(r.sequence_id, []).append(r)
    for b in bins.values():
        assert sum(r.n_tokens for r in b) <= 1024 and len(b) <= 5 and sum(r.n_loss for r in b) <= 600
    assert sum(r.n_loss for b in bins.values() for r in b) / len(bins) / 600 > 0.75 or sum(r.n_tokens for b in bins.values() for r in b) / len(bins) / 1024 > 0.85


def test_conversations_are_packed_under_three_limits(spark):
    from visret.llm import queries

    plain, want = Tokenizer.from_file(tokens.WORDS), {}
    for r in read(spark, SF, "conversations").collect():
        n = len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1
        a, b = want.get(r.conv_id, (0, 0))
        want[r.conv_id] = (a + n, b + n * (r.role == "assistant"))
    rows = queries.conversation_packing(spark, SF).collect()
    assert {r.id: (r.n_tokens, r.n_loss) for r in rows} == want and len(rows) == len(want)
    bins = {}
    for r in rows:
        assert (r.sequence_id is None) == (r.n_tokens > 4096 or r.n_loss > 2048)
        bins.setdefault(r.sequence_id, []).append(r)
    full = {k: [sum(r.n_tokens for r in b) / 4096, len(b) / 16, sum(r.n_loss for r in b) / 2048] for k, b in bins.items() if k is not None}
    assert all(max(f) <= 1 for f in full.values()) and max(f[2] for f in full.values()) > 0.9  # loss binds
    odd_turns = spark.createDataFrame([(1, "assistant", None), (1, None, "a b"), (None, "assistant", "x"), (1, "assistant", None)], "conv_id long, role string, text string")
    assert {(r.id, r.n_tokens, r.n_loss) for r in packing.conversation_sizes(odd_turns).collect()} == {(1, 5, 2), (None, 2, 2)}
    assert packing.pack_examples(packing.conversation_sizes(odd_turns.limit(0))).count() == 0


def test_ties_are_packed_in_the_order_of_waiting():
    pool = packing.Bin((10, 4, 10))
    pool.add(["a", "b", "c", "d"], [(5, 1, 5)] * 4)
    assert packing.fill_whole(pool) == ["a", "d"] and packing.fill_whole(pool) == ["c", "b"]


@pytest.mark.parametrize("block", [7, token_scan.BLOCK_TOKENS])
def test_token_counts_equal_the_tokenizers(spark, monkeypatch, block):
    monkeypatch.setattr(token_scan, "BLOCK_TOKENS", block)
    monkeypatch.setattr(token_scan.read_blocks, "__kwdefaults__", {"block_tokens": block})
    texts = [(i, t) for i, t in enumerate(STRANGE)] + [(100, None), (101, "word " * 3000), (101, "again"), (None, "</s> <s>\x02\x00 none")]
    d = spark.createDataFrame([(i, t, "clash", "clash") for i, t in texts], "doc_id long, text string, file string, names string").repartition(2)
    plain = sentencepiece.SentencePieceProcessor(model_file=token_scan.PIECES)
    want = sorted(((i or -1, len(plain.encode(t or ""))) for i, t in texts))
    rows = token_scan.of_documents(d).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == sorted((i or -1, n) for i, n in want) and all(r.ended for r in rows)
    assert len({(r.file, r.doc_no) for r in rows}) == len(rows)
    assert token_scan.of_documents(d.limit(0)).count() == 0


def test_token_counts_do_not_depend_on_the_session(spark):
    d = read(spark, SF, "documents")
    plain = sorted((r.doc_id, r.n_tokens) for r in token_scan.of_documents(d).collect())
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "30")
    try:
        assert sorted((r.doc_id, r.n_tokens) for r in token_scan.of_documents(d).collect()) == plain and len(plain) == d.count()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_flat_files_hold_nothing_but_ids(spark, tmp_path):
    d = spark.createDataFrame([(1, "one two"), (2, ""), (3, "three")], "doc_id long, text string").coalesce(1)
    ids, _ = token_scan.write_files(d, str(tmp_path / "flat"))
    [file] = Path(ids).glob("part-*")
    plain = sentencepiece.SentencePieceProcessor(model_file=token_scan.PIECES)
    assert np.fromfile(file, "<u2").tolist() == [*plain.encode("one two"), 2, 2, *plain.encode("three"), 2]
    with pytest.raises(Exception, match="separator"):
        token_scan.write_files(d, str(tmp_path / "not"), end=plain.encode("one")[0])


@pytest.mark.parametrize("ranges", [True, False])
def test_flat_files_are_stitched_over_blocks(spark, tmp_path, monkeypatch, ranges):
    monkeypatch.setattr(token_scan, "CHUNK", 3)
    if not ranges:  # a store that only Spark can read
        monkeypatch.setattr(token_scan, "range_reader", lambda path: token_scan.fs.FileSystem.from_uri("nowhere://x"))
    x = np.random.default_rng(0).integers(0, 9, 1000).astype("<u2")
    x[100:400] = 1
    files = {"a": x, "b": x[:400], "c": x[:0], "d": np.array([3, 3, 3], "<u2")}
    for name, ids in files.items():
        ids.tofile(tmp_path / f"{name}.bin")
    blocks = token_scan.read_blocks(spark, str(tmp_path), block_tokens=50)
    assert blocks.agg(F.max(F.length("data"))).first()[0] == 100  # whatever the size of the file
    rows = token_scan.count_tokens(blocks, end=3).collect()
    for name, ids in files.items():
        got = sorted((r.doc_no, r.start, r.n_tokens, r.ended) for r in rows if r.file.endswith(f"{name}.bin"))
        ends = np.flatnonzero(ids == 3).tolist()
        begins = [0, *[e + 1 for e in ends]]
        want = [(i, b, e - b, True) for i, (b, e) in enumerate(zip(begins, ends, strict=False))]
        if begins[-1] < len(ids):
            want.append((len(ends), begins[-1], len(ids) - begins[-1], False))
        assert got == want


def judged_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([len(rest), *(rest.index(c) for c in "/?#" if c in rest)])
        host, path = rest[:cut], rest[cut:]
        path = path[:min([len(path), *(path.index(c) for c in "?#" if c in path)])]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


URLS = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?y", "http://example.com/en/", "http://a.example.com/en", "x://net/fr/1#a://b", "http://É.NET", "a://b.com?q", "a://com/x\ny",
        "http://u@h.net:80/es/1", "http://x.org/1/2/3/4/5/6/7/8/9", "http://xnet/es/", "://net/es/"]


def made_form(path):
    parts = (path[1:] if path.startswith("/") else path).split("/")
    return tuple("{x}" if re.fullmatch("[0-9a-fA-F-]{16,}", s) else re.sub("[0-9]+", "{n}", s) for s in parts)


def tree_of(forms):
    """The template tree of one host in plain Python: ``forms`` maps a form to [n, blocked, allowed];
    returns form -> (branches, purity of the branch above)."""
    out, smooth = {}, lambda rows, prior: (sum(r[2] for r in rows) + url_filter.PRIOR * prior) / (sum(r[2] + r[3] for r in rows) + url_filter.PRIOR)
    chance = lambda a, b: np.sqrt(np.log(2 / url_filter.ALPHA) / 2) * (1 / np.sqrt(a) + 1 / np.sqrt(b))
    few = lambda ways: len(ways) >= url_filter.MANY and sum(ways.values()) < url_filter.THIN * len(ways)

    def ended(rows, made, above):
        out.update({r[4]: (made, above) for r in rows if not r[0]})
        return [r for r in rows if r[0]]

    def grow(rows, made, purity, above):  # a row is (rest, n, blocked, allowed, form)
        if not rows:
            return
        lo, hi = min(r[0] for r in rows), max(r[0] for r in rows)
        k = next((i for i, (x, y) in enumerate(zip(lo, hi)) if x != y), min(len(lo), len(hi)))  # noqa: B905
        rows = ended([(r[0][k:], *r[1:]) for r in rows], made := made + lo[:k], above)
        first = {}
        for r in rows:
            first[r[0][0]] = first.get(r[0][0], 0) + r[1]
        branch = {}
        for r in rows:
            branch.setdefault("*" if few(first) else r[0][0], []).append(r)
        ways, whole = {}, {}
        for s, own in branch.items():
            w = {}
            for r in own:
                next_ = "/" + r[0][1] if len(r[0]) > 1 else ""
                w[next_] = w.get(next_, 0) + r[1]
            ways[s] = {"*": sum(w.values())} if few(w) else w
            whole[s] = (sum(w.values()), s, sum(r[2] for r in own), sum(r[2] + r[3] for r in own), max((n, x) for x, n in ways[s].items())[1])
        merged = {}
        for s, mine in whole.items():
            head = max(x for x in whole.values() if x[4] == mine[4])
            apart = sum(max(0.0, n / mine[0] - ways[head[1]].get(x, 0) / head[0]) for x, n in ways[s].items())
            same = apart <= chance(mine[0], head[0])
            if mine[3] >= url_filter.LABELS and head[3] >= url_filter.LABELS:
                same &= abs(mine[2] / mine[3] - head[2] / head[3]) <= chance(mine[3], head[3])
            merged.setdefault(head[1] if same else s, []).append(s)
        for group in merged.values():
            own = [(r[0][1:], *r[1:]) for s in group for r in branch[s]]
            to = (*made, min(group) + (f"|{len(group)}" if len(group) > 1 else ""))
            grow(ended(own, to, purity), to, smooth(own, purity), purity)

    return grow, out, smooth


def brute_verdicts(urls):
    """Verdict and template of each distinct url, by a tree in plain Python."""
    hosts, blocked, labelled = {}, 0, 0
    for u in urls:
        host, path, _, verdict = judged_url(u)
        f = hosts.setdefault(host, {}).setdefault(made_form(path), [0, 0, 0])
        f[0] += 1
        f[1] += verdict == "block"
        f[2] += verdict == "allow"
        blocked, labelled = blocked + (verdict == "block"), labelled + (verdict is not None)
    found = {}
    for host, forms in hosts.items():
        grow, out, smooth = tree_of(forms)
        rows = [(f, *n, f) for f, n in forms.items()]
        base = smooth(rows, blocked / max(1, labelled))
        grow(rows, (), base, base)
        groups = {}
        for f, (made, above) in out.items():
            groups.setdefault(made, []).append((f, above))
        for made, some in groups.items():
            own = [(f, *forms[f]) for f, _ in some]
            purity = smooth(own, some[0][1])
            for f, _ in some:
                found[host, f] = ("/" + "/".join(made), "block" if sum(r[2] + r[3] for r in own) and purity >= url_filter.REJECT else "allow")
    out = {}
    for u in urls:
        host, path, rule, verdict = judged_url(u)
        template, own = found[host, made_form(path)]
        out[u] = (host, path, rule, verdict or own, template)
    return out


def check_urls(spark, urls):
    rows = list(enumerate(urls))
    want, got = brute_verdicts(urls), url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict, r.template) == want[urls[r.page_id]]
    return got


def test_urls_equal_a_tree_in_plain_python(spark):
    got = check_urls(spark, [r.url for r in read(spark, SF, "pages").collect()] + URLS)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_made_hosts_equal_a_tree_in_plain_python(spark):
    rng = np.random.default_rng(3)
    pick = lambda xs: xs[rng.integers(len(xs))]
    urls = []
    for h in ("a.net", "b.net", "c.example.com", "d.org"):
        for _ in range(400):
            depth = int(rng.integers(1, 8))
            urls.append(f"http://{h}/" + "/".join([pick(["es", "fr", "en", "it"]), *(pick(["x", "y", "z", str(rng.integers(99)), f"w{rng.integers(40)}q"]) for _ in range(depth))]))
    urls += ["http://a.net/es/" + "trap/" * 300 + str(i) for i in range(20)] + ["http://e.org/" + "long" * 20_000]
    check_urls(spark, urls)


def test_judging_of_odd_rows(spark):
    d = spark.createDataFrame([(None, "http://a.net/es/1", "clash", "clash"), (1, None, "x", "y"), (1, None, "x", "y")], "page_id long, url string, host string, verdict string")
    assert sorted((r.page_id or 0, r.host, r.verdict) for r in url_filter.judge(d).collect()) == [(0, "a.net", "block"), (1, "", "allow"), (1, "", "allow")]
    assert url_filter.judge(d.limit(0)).count() == 0


def test_a_null_url_is_allowed_whatever_most_labels_say(spark):
    urls = [None, "", "http://x.org/a"] + [f"http://a.net/es/{i}" for i in range(50)]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).collect()
    assert {r.verdict for r in rows if r.page_id < 3} == {"allow"} and {r.verdict for r in rows if r.page_id > 2} == {"block"}


def test_templates_generalise_merge_and_reject(spark):
    urls = [f"http://a.net/es/{i}" for i in range(40)] + [f"http://a.net/fr/{i}" for i in range(40)] + [f"http://a.net/u/{chr(97 + i)}{chr(97 + i)}/p" for i in range(26)]
    urls += [f"http://b.org/{s}/{i}" for s in ("x", "y") for i in range(30)]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).collect()
    made = {(r.host, r.template) for r in rows}
    assert made == {("a.net", "/es|2/{n}"), ("a.net", "/u/*/p"), ("b.org", "/x|2/{n}")}
    assert all(r.purity >= url_filter.REJECT for r in rows if r.template == "/es|2/{n}")


def test_urls_without_a_rule_get_the_verdict_of_their_branch(spark):
    urls = [f"http://c.com/{i}" for i in range(400)] + [f"http://a.net/es/{i}" for i in range(40)] + [f"http://a.net/it/{i}" for i in range(10)]
    urls += [f"http://a.net/u/{s}/{t}/{i}" for s in "pq" for t in "xy" for i in range(20)] + [f"http://d.net/es/{i}" for i in range(60)]
    urls += ["http://d.net/odd/q", "http://e.org/es/1"]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).collect()
    of = {(r.host, r.path.rstrip("0123456789")): r for r in rows}
    assert of["a.net", "/it/"].template == "/es|2/{n}" and of["a.net", "/it/"].verdict == "block"
    assert {of["a.net", f"/u/{s}/{t}/"].template for s in "pq" for t in "xy"} == {"/u/p|2/x|2/{n}"}
    assert of["d.net", "/odd/q"].verdict == of["a.net", "/u/p/x/"].verdict == "allow"  # no label of their own
    assert of["e.org", "/es/"].verdict == "allow"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header class="site-header"><p>Site name</p></header><nav><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></nav>
<div class="cookie-consent"><p>We use cookies to improve this site.</p></div>
<article><h1>Big  <b>news</b>&amp;more</h1><p>First&nbsp;par<i>agraph</i> of the story, it is long enough to count as text.<p>Second &lt;b&gt; paragraph,<br>also with some words &#233; in it.
<ul><li>One thing<li>Another thing</ul><div class="advert">Buy now</div><script>x()</script><!-- <p>gone</p> --></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/x>Other story</a></ul></aside>
<section id="comments"><h3>Comments</h3><div class="comment"><p>Nice story, I liked it very much, thank you.</p></div></section>
<form><label>Mail</label><input><button>Subscribe</button></form><footer><p>&copy; 2024 Site</p></footer></body></html>"""
TEXT = "Big news&more First paragraph of the story, it is long enough to count as text. Second <b> paragraph, also with some words é in it. One thing Another thing"


def test_main_text_of_pages(spark):
    from html import unescape

    p = read(spark, SF, "pages")
    extra = spark.createDataFrame([(10**6, "u", PAGE), (10**6 + 1, None, None), (10**6 + 2, "u", ""), (10**6 + 3, "u", "<"), (10**6 + 3, "u", "<"), (10**6 + 4, "u", "<p>" * 3000 + "deep")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in html_text.main_text(p.unionByName(extra)).collect()}
    assert rows[10**6].text == TEXT
    assert [rows[10**6 + i].text for i in (1, 2)] == ["", ""] and all(r.n_chars == len(r.text) for r in rows.values())
    for r in p.collect():
        article = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        assert rows[r.page_id].text == " ".join(unescape(re.sub(r"<[^>]+>", " ", article)).split())
    assert html_text.main_text(p.limit(0)).count() == 0


# Pages of kinds that the training layouts don't have, and their main text. Most have neither article nor main.
SITES = [
    ("""<html><body bgcolor=white><table width=100%><tr><td colspan=2><a href=/>Home</a> | <a href=/n>News</a> | <a href=/c>Contact us</a></td></tr><tr><td class=leftmenu><a href=1>One</a><br><a href=2>Two</a><br><a href=3>Three</a></td>
<td class=content><h1>Harvest begins early</h1><p>Farmers in the valley began the harvest this week, a month before the usual date.</p><p>Warm days in spring, they say, are the cause of it.</p></td></tr></table><div class=footer>Copyright 1999 Valley News</div></body></html>""",
     "Harvest begins early Farmers in the valley began the harvest this week, a month before the usual date. Warm days in spring, they say, are the cause of it."),
    ("""<body><div class="navbar"><a href="/">Start</a><a href="/blog">Blog</a></div><div class="blog-post"><h2 class="post-title">A walk in the rain</h2><div class="post-body"><p>It rained all morning, so we took our coats and went out anyway.</p><p>Nobody else was on the path, and the river was loud.</p></div></div><div class="post-comments"><div class="comment"><b>Ann</b><p>Lovely, I wish I had been there with you.</p></div></div></body>""",
     "A walk in the rain It rained all morning, so we took our coats and went out anyway. Nobody else was on the path, and the river was loud."),
    ("""<body><header><div class=logo>The Daily</div></header><div id=content><h1>Bridge to close</h1><p>The old bridge will close for repairs in June, the council has said.<p>Traffic is to be led through the town, where delays are likely.</div><aside><h4>Most read</h4><ul><li><a href=a>Why cats sleep</a><li><a href=b>Ten cheap meals</a></ul></aside><footer>All the news, every day</footer></body>""",
     "Bridge to close The old bridge will close for repairs in June, the council has said. Traffic is to be led through the town, where delays are likely."),
    ("""<body><div id="cookie-banner" role="dialog">This site uses cookies. <button>Accept</button></div><div role="main"><h1>Setting up</h1><p>First install the package, then start the service with one command.</p><pre>run --now</pre><p>Logs are written to the folder that you named in the file.</p></div><nav class="toc"><ul><li><a href=#a>Setting up</a></li><li><a href=#b>Running</a></li></ul></nav></body>""",
     "Setting up First install the package, then start the service with one command. run --now Logs are written to the folder that you named in the file."),
    ("""<body><div class="wrap"><div class="top-menu"><ul><li><a href=1>Shop</a></li><li><a href=2>Basket</a></li></ul></div><div class="entry-content"><p>This lamp is made of brass and glass, and stands thirty centimetres tall.</p><p>It takes one bulb, which comes with it, and a cable of two metres.</p></div><div class="newsletter-signup"><form><label>Your mail</label><input name=m><button>Subscribe</button></form></div></div></body>""",
     "This lamp is made of brass and glass, and stands thirty centimetres tall. It takes one bulb, which comes with it, and a cable of two metres."),
    ("""<body><section class="story"><h1>Old mill finds new owner</h1><p>After ten empty years the mill on the hill has been sold to a family of bakers.</p><div class="advertisement">Buy two, get one free at the market!</div><p>They plan to grind their own flour there from the autumn on.</p></section><section class="related-stories"><h3>Related</h3><a href=1>Bakery wins prize</a><a href=2>Hill path reopened</a></section></body>""",
     "Old mill finds new owner After ten empty years the mill on the hill has been sold to a family of bakers. They plan to grind their own flour there from the autumn on."),
    ("""<body><div id=page><div id=masthead>Science Notes</div><div id=primary><div class=hentry><h1 class=entry-title>Why the sky is blue</h1><div class=entry-content><p>Light of short waves is scattered more by the air than light of long ones.</p><blockquote><p>The sky is a filter, as one teacher used to say.</p></blockquote><p>At dusk the way through the air is longer, and red is what is left.</p></div></div></div><div id=secondary class=widget-area><ul><li><a href=m>March</a></li><li><a href=a>April</a></li></ul></div><div id=colophon>Powered by letters</div></div></body>""",
     "Why the sky is blue Light of short waves is scattered more by the air than light of long ones. The sky is a filter, as one teacher used to say. At dusk the way through the air is longer, and red is what is left."),
    ("""<body><div class="site-header"><a href=/>Recipes</a></div><div class="main-content"><h1>Plain bread</h1><ul><li>500 g of flour, white or brown</li><li>300 g of warm water</li><li>salt and a little yeast</li></ul><p>Mix it all, let it rest for the night, and bake it hot in the morning.</p></div><div class="social-share"><a href=f>Share</a><a href=t>Tweet</a></div><div class="site-footer">Imprint, privacy and terms</div></body>""",
     "Plain bread 500 g of flour, white or brown 300 g of warm water salt and a little yeast Mix it all, let it rest for the night, and bake it hot in the morning."),
    ("""<body><main><div class="breadcrumbs"><a href=/>Home</a> / <a href=/h>History</a></div><h1>The first road</h1><p>The first road to the coast was laid by hand, and it took eleven summers.</p><p>Parts of it can still be walked today, if one knows where to look.</p></main><footer><p>Museum of roads, open daily</p></footer></body>""",
     "The first road The first road to the coast was laid by hand, and it took eleven summers. Parts of it can still be walked today, if one knows where to look."),
    ("""<body><article><header><h1>Night trains return</h1></header><p>Three lines that were closed years ago will run again from December.</p><figure><img src=t.jpg><figcaption>A train at dawn</figcaption></figure><p>Tickets go on sale next month, with beds and with seats.</p></article><div id="comments"><h3>Comments</h3><ol class="comment-list"><li>Finally, I have waited for this for years now!</li></ol></div></body>""",
     "Night trains return Three lines that were closed years ago will run again from December. A train at dawn Tickets go on sale next month, with beds and with seats."),
    ("""<body><div class="menu"><a href=1>Index</a></div><div class="text"><p>Call me what you like, said the captain, so long as you come when I call.</p><p>And with that he went below, and was not seen till morning.</p><p>The wind had turned by then, and we were far from land.</p></div><div class="ad-slot">Cheap flights to the sun</div></body>""",
     "Call me what you like, said the captain, so long as you come when I call. And with that he went below, and was not seen till morning. The wind had turned by then, and we were far from land."),
    ("""<body><nav><a href=/>Home</a></nav><div class="prose"><h1>Notes on clocks</h1><p>A clock that is right twice a day is a stopped clock, as everybody knows.</p><p>One that is a minute fast is never right, and yet of more use.</p></div><div class="alert notice">We have changed our terms of use.</div></body>""",
     "Notes on clocks A clock that is right twice a day is a stopped clock, as everybody knows. One that is a minute fast is never right, and yet of more use."),
]


def shares(text, want):
    a, b = text.split(), want.split()
    both = sum((Counter(a) & Counter(b)).values())
    return both / max(1, len(a)), both / len(b)


def test_sites_of_kinds_that_training_does_not_make(spark):
    made = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(SITES)], "page_id long, url string, html string")
    f = html_text.extractor(spark, html_text.fit(read(spark, SF, "pages")))
    got = {r.page_id: shares(r.t, SITES[r.page_id][1]) for r in made.select("page_id", f("html").alias("t")).collect()}
    assert np.mean([p for p, _ in got.values()]) > 0.9 and np.mean([r for _, r in got.values()]) > 0.9, got
    assert sum(p > 0.95 and r > 0.95 for p, r in got.values()) >= 10, got


def test_a_long_page_of_the_smallest_draw_is_passed_over(spark, monkeypatch):
    monkeypatch.setattr(html_text, "SAMPLE_CHARS", 40_000)
    monkeypatch.setattr(html_text, "MADE", 5)
    pools = []
    monkeypatch.setattr(html_text, "layout", lambda rng, pool, made=html_text.layout: pools.append(pool) or made(rng, pool))
    pages = read(spark, SF, "pages").select("page_id", "url", "html")
    draw = pages.select(F.min(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)))).first()[0]
    first = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) == draw
    html_text.fit(pages.withColumn("html", F.when(first, F.concat("html", F.repeat(F.lit("<p>long</p>"), 1000))).otherwise(F.col("html"))))
    assert len(pools[0]) > 30 and "long" not in pools[0]


def test_a_table_of_pages_without_main_elements(spark):
    """The texts of all sampled pages serve, also where no page tells its main part; and a page
    longer than all that the sample may hold is read whole."""
    rows = [(i, "u", SITES[i % 12][0].replace("<article>", "<div class=post>").replace("<main>", "<div class=entry>")) for i in range(60)]
    rows.append((99, "u", "<body><nav><a href=/>Home</a></nav><div class=post>" + "<p>One more paragraph of a very long page, with words in it.</p>" * 150_000 + "</div></body>"))
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    full = [shares(got[i].text, SITES[i % 12][1]) for i in range(60)]
    assert np.mean([p for p, _ in full]) > 0.85 and np.mean([r for _, r in full]) > 0.85
    assert got[99].text.count("One more paragraph") == 150_000 and got[99].n_chars == len(got[99].text)


@pytest.mark.parametrize("piece", ['<p x="', '<p =">" ', "</script ", "<", "<!--", "&", "<div>", "<tr><td>", "<p a=1 ", "<i>", "</x>"])
def test_hostile_pages_take_time_in_proportion(piece):
    began = time.process_time()
    html_text.parse("<script>" * (piece == "</script ") + piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 5


def texts_in(source, **options):
    return [t for t in html_text.parse(source, **options).texts if t]


def test_parsing_of_odd_markup():
    assert texts_in('<p>one <span data-main="x">two</span> three</p>') == ["one two three"]
    assert texts_in('<p>one <span data-main="x">two</span> three</p>', marks=True) == ["one", "two", "three"]
    assert texts_in("<div>a <svg><text>no</text></svg> b <video src=v>fallback<p>no</div><p>kept") == ["a", "b", "kept"]
    assert texts_in("<div><iframe>no</div><p>kept<noscript>no") == ["kept"]
    assert texts_in('<p title="it\'s">a</p><a href=x"y>b</a> 1 < 2 & 3 <b') == ["a", "b 1 < 2 & 3 <b"]
    assert texts_in("<p>a<script>x = '<p>'</script >b<textarea><p>no</textarea><style>p{}") == ["ab"]
    assert texts_in("<ul><li>a<li>b<ul><li>c</ul>d<li>e</ul>f") == ["a", "b", "c", "d", "e", "f"]
    assert texts_in("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]


def test_decoding_never_contradicts_itself():
    """No kept node below one that is not, and no set of nodes of that kind has a larger sum."""
    rng = np.random.default_rng(1)
    pages = [html_text.parse(html_text.layout(rng, ["Some words here.", "More, and more."])) for _ in range(30)]
    for page in pages:
        odds = rng.normal(size=len(page.parent))
        kept = html_text.kept(page, odds)
        assert all(kept[page.parent[i]] for i in range(1, len(kept)) if kept[i])
        assert html_text.decode(page, odds) == [t for t, k in zip(page.texts, kept, strict=True) if t is not None and k]
        gain = [o * (1 + np.log1p(c)) for o, c in zip(odds, page.chars, strict=True)]
        best = gain[:]
        for i in range(len(best) - 1, 0, -1):
            best[page.parent[i]] += max(0.0, best[i])
        assert np.isclose(sum(g for g, k in zip(gain, kept, strict=True) if k), best[0])


def test_trees_learn_what_one_split_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = html_text.Trees().fit(x, y, np.ones(2000))
    assert ((model.log_odds(x) > 0) == y).mean() > 0.97

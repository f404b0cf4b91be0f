"""Small tests of the training-data operators: brute force, round trips, held-out accuracy, odd inputs."""

import os
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import (common, exact_dedup, html_extract, ngram_join, packing, quality, queries, sentencepiece_codec, sharding,
                             token_binary, tokens, url_filter, vector_search)
from tablewright import session
from tests.oracle import duck, rows

SF = "/root/testdata/sf0.001"
ODD = [(1, "a b c d e f g"), (2, None), (3, ""), (4, "a b c d e f g"), (5, "x " * 30_000), (6, "one"), (7, "a B c d e f g"), (7, "a B c d e f g"),
       (None, "lonely text without an id"), (9, "é 中 😀 <|endoftext|>\x0b\n")]


def frame(spark, data=ODD):
    """Documents with extra columns whose names clash with those the operators make."""
    return spark.createDataFrame([(*r, "x", 1, "y") for r in data], "doc_id long, text string, shard string, n int, keep_id string")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_oracles(spark, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck(SF).execute(queries.SQL[name]).df()
    assert rows(got) == rows(want)


# ---------------------------------------------------------------- 1

def _best_score(codec, word, scores):
    best = [0.0] + [-np.inf] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            p = word[s:e]
            score = scores.get(p, codec.unknown_score if e - s == 1 else -np.inf)
            best[e] = max(best[e], best[s] + score)
    return best[-1]


def test_sentencepiece_paths_are_best_and_come_back():
    c = sentencepiece_codec.codec()
    scores = {p: v[2] for p, v in c.automaton.items()}
    piece = {v[1]: v for v in c.automaton.values()}
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice("ab  theion.,%é中\n\t😀") for _ in range(r.randint(0, 25)))
        ids = c.encode(text)
        assert c.decode(ids) == text
        if text:
            marked = sentencepiece_codec.MARK + text.replace(" ", sentencepiece_codec.MARK)
            unknown = len({i for i, ch in enumerate(marked) if ch not in c.single})
            got = sum(piece[i][2] for i in ids if i in piece) + unknown * c.unknown_score
            assert got == _best_score(c, marked, scores)
            assert ids == c.path(marked)


def test_sentencepiece_rows(spark):
    got = sentencepiece_codec.round_trip(frame(spark)).toPandas()
    assert len(got) == len(ODD) and got["same"].all() and (got["n_tokens"] == got["ids"].map(len)).all()
    back = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(frame(spark))).toPandas()
    assert sorted(back["text"]) == sorted(t or "" for _, t in ODD)


# ---------------------------------------------------------------- 2

def test_cuckoo_index_inserts_deletes_and_grows():
    index, r = exact_dedup.CuckooIndex(2), random.Random(5)
    keys = [r.randbytes(32) for _ in range(3000)]
    for i, k in enumerate(keys):
        index.insert(k, i)
    assert all(index.values[index.find(k)] == i for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert [index.find(k) >= 0 for k in keys] == [i % 2 == 1 for i in range(3000)] and index.live == 1500
    same = keys[1][:-10] + bytes(10)
    assert index.find(same) < 0


def test_dedup_odd_rows_and_flush(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark), flush_at=2).collect()}
    assert got == {(1, 4, 2, False), (4, 4, 2, True), (2, 3, 2, False), (3, 3, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 2, True),
                   (None, None, 1, True), (9, 9, 1, True)}


def test_live_index_follows_batches(spark):
    index = exact_dedup.live_index(frame(spark), shards=3)
    after = exact_dedup.update_index(index, frame(spark, [(20, "new"), (21, "one")]), frame(spark, [(0, "a b c d e f g"), (8, "not there")]), shards=3)
    live = {r.keep_id: r.live for r in after.collect() if r.keep_id}
    assert live == {3: 2, 4: 1, 5: 1, 6: 2, 7: 2, 9: 1, 20: 1}        # one of two copies went, the text stays
    gone = exact_dedup.update_index(after, frame(spark, []), frame(spark, [(1, "a b c d e f g"), (6, "one"), (21, "one")]), shards=3)
    assert sorted(r.keep_id for r in gone.collect() if r.keep_id) == [3, 5, 7, 9, 20]


# ---------------------------------------------------------------- 3 and 6

def test_packing_bounds_and_round_trip(spark):
    r = np.random.default_rng(1)
    for _ in range(30):
        n = r.integers(1, 64, 40)
        bins, offset, used = packing.best_fit_decreasing(n, 64)
        assert all(n[bins == b].sum() <= 64 for b in range(used))
        assert packing.lower_bound(np.bincount(n, minlength=65), 64) <= used
        members = token_binary.pack_window(n.tolist(), 64)
        assert sorted(i for m in members for i in m) == list(range(40)) and len(members) == used


def _check_pieces(got, data, size):
    for doc, text in {(d, t or "") for d, t in data}:
        ids = tokens.document_ids(text)
        mine = got[got["doc_id"].isna() if doc is None else got["doc_id"] == doc].drop_duplicates("piece").sort_values("piece")
        assert mine["length"].sum() == len(ids) and (mine["length"].iloc[1:] == size).all()
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s["offset"] == s["length"].cumsum() - s["length"]).all() and s["length"].sum() <= size


@pytest.mark.parametrize("per_part", [100_000, 2])
def test_packed_documents(spark, per_part):
    _check_pieces(packing.pack_documents(frame(spark), size=64, per_part=per_part).toPandas(), ODD, 64)


def test_token_binary_round_trip(spark, tmp_path):
    token_binary.write_token_binary(frame(spark), f"{tmp_path}/out", size=64, window_tokens=500)
    packed = spark.read.parquet(f"{tmp_path}/out")
    _check_pieces(token_binary.segments(packed).toPandas(), ODD, 64)
    row = packed.first()
    assert len(row["ids"]) == 128 and token_binary.position_ids(row["n_tokens"], np.array(row["resets"])).max() < 64


def test_fast_ids_equal_the_tokenizer_file():
    r = random.Random(9)
    for _ in range(300):
        t = "".join(r.choice(["the", " ", "  ", "\n", "é", "ß", "'s", "42", "!!", "\t", "Über", "<|endoftext|>", "中", "\u00a0"]) for _ in range(r.randint(0, 40)))
        assert tokens.encode(t).tolist() == tokens._exact("byte_bpe_50k").encode(t, add_special_tokens=False).ids


def test_added_tokens_have_their_ids():
    from tokenizers import Tokenizer
    fresh = Tokenizer.from_file(common.vocabulary("byte_bpe_50k.json"))
    for t in ("end.<|endoftext|>Next", "<|endoftext|>", "中<|endoftext|> é", "plain < text |>"):
        assert tokens.encode(t).tolist() == fresh.encode(t, add_special_tokens=False).ids


# ---------------------------------------------------------------- 4

def _words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _brute(data):
    sets = [_words(t) for _, t in data]
    root = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [root[j] if x == root[i] else x for x in root]
    smallest = {}
    for (d, _), x in zip(data, root, strict=True):
        smallest[x] = min(d, smallest.get(x, d))
    return {(d, len(s), smallest[x]) for (d, _), s, x in zip(data, sets, root, strict=True)}


@pytest.mark.parametrize("options", [{}, {"pair_list": 2, "long_list": 3, "block_shingles": 60, "block_sets": 4}])
def test_ngram_join_against_brute_force(spark, options):
    r = random.Random(4)
    data = [(d, t) for d, t in ODD if d and d != 7]
    base = [[f"w{r.randrange(50)}" for _ in range(r.randint(3, 90))] for _ in range(6)]
    for k in range(60):
        w = list(base[k % 6])
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"v{r.randrange(3)}"
        data.append((100 + k, (" " if k % 2 else "\t").join(w)))
    got = {tuple(x) for x in ngram_join.ngram_join(frame(spark, data), **options).collect()}
    assert got == _brute(data)


def test_ngram_entries_are_sent_in_small_parts(spark):
    """A worker sends its entries before they are many: more rows than the 64 slices of one sending."""
    data = [(d, " ".join(f"{d}.{i}" for i in range(20_000))) for d in range(45)]       # 4000 entries each
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    rare = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    rows = ngram_join.prefix_entries(docs, rare, 900_000, 5, 80, 100).selectExpr("count(*) n", "sum(length(entries)) b").first()
    assert rows.n > 64 and rows.b >= 45 * 3999 * ngram_join._ENTRY.itemsize


def test_ngram_join_sf(spark):
    docs = common.table(spark, SF, "documents", "doc_id", "text")
    assert {tuple(x) for x in ngram_join.ngram_join(docs).collect()} == _brute([tuple(x) for x in docs.collect()])


# ---------------------------------------------------------------- 5

def test_shards_hold_the_law(spark):
    data = [(i, f"text {i % 40 if i % 3 else 'hot'} " * (1 + i % 7)) for i in range(600)] + [(1000, None), (1001, "")]
    got = sharding.shard_documents(frame(spark, data)).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == len(data) and set(got["shard"]) == set(range(16))
    assert sizes.max() - sizes.min() <= 2 * got["size"].max()
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])
    assert got[got["doc_id"] >= 1000]["size"].tolist() == [1, 1] and got["grown_shard"].isna().all()


# ---------------------------------------------------------------- 7

def test_urls(spark):
    data = [(1, "HTTP://WWW.Example.com/en/x?q#f"), (2, "http://a.b.example.com/en/"), (3, None), (4, "no scheme"), (5, "x://"), (6, "x://net/es/"),
            (7, "x://internet/es/"), (8, "x://ads.example.org"), (9, "x://ads.example.org/p"), (10, "x://example.com/EN/")]
    pages = spark.createDataFrame([(*r, "z") for r in data], "page_id long, url string, rule string")
    listed = url_filter.rule_rows(spark, queries.RULES).unionByName(url_filter.listed_hosts(pages))
    got = {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(pages, listed).collect()}
    assert got == {1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("a.b.example.com", "/en/", "example.com/en/", "block"),
                   3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("net", "/es/", "net/es/", "block"),
                   7: ("internet", "/es/", None, "allow"), 8: ("ads.example.org", "", None, "block"), 9: ("ads.example.org", "/p", None, "block"),
                   10: ("example.com", "/EN/", "com/", "allow")}
    assert url_filter.filter_urls(pages, listed.limit(0)).where("verdict = 'allow'").count() == len(data)


def test_bloom_has_no_false_negatives():
    h = common.mix64(np.arange(1, 5001, dtype=np.uint64))
    bloom = common.BlockedBloom(np.zeros(8 * common.BlockedBloom.blocks_for(5000), np.uint64))
    for at, mask in bloom.places(h, len(bloom.words) // 8):
        np.bitwise_or.at(bloom.words, at, mask)
    assert bloom.has(h).all() and bloom.has(common.mix64(np.arange(10**6, 10**6 + 5000, dtype=np.uint64))).mean() < 0.05


# ---------------------------------------------------------------- 8

def test_nearest_neighbours_recall_and_odd_vectors(spark):
    emb = common.table(spark, SF, "embeddings", "vec_id", "embedding")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 20, [0.0] * 64), (10**6 + 40, [float("nan")] * 64), (10**6 + 60, [1.0])], "vec_id long, embedding array<float>")
    got = vector_search.nearest(emb.unionByName(odd).withColumn("rank", F.lit("x")), per_shard=200).toPandas()
    data = emb.toPandas()
    v = np.array(data["embedding"].tolist(), np.float64)
    hits = total = 0
    for q in data["vec_id"][data["vec_id"] % 20 == 0]:
        i = int(np.flatnonzero(data["vec_id"] == q)[0])
        s = v @ v[i]
        s[i] = -np.inf
        want = set(data["vec_id"].to_numpy()[np.argsort(-s)[:20]])
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and (mine["score"].diff().dropna() <= 0).all()
        hits, total = hits + len(want & set(mine["vec_id"])), total + 20
    assert hits / total >= 0.9
    assert got["query_id"].max() < 10**6
    few = vector_search.nearest(emb.where("vec_id < 5")).toPandas()
    assert few["vec_id"].tolist() and set(few["query_id"]) == {0} and len(few) == 4
    assert vector_search.nearest(emb.limit(0)).count() == 0


def _recall(spark, v, **options):
    """Recall at 20, with scores as inner products in double precision; every query gets all it can."""
    got = vector_search.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), **options).toPandas()
    hits = total = 0
    with np.errstate(over="ignore"):
        for q in range(0, len(v), 20):
            score = np.einsum("ij,j->i", v, v[q])
            mine = got[got["query_id"] == q].sort_values("rank")
            assert mine["rank"].tolist() == list(range(1, 1 + min(20, len(v) - 1))) and (mine["score"].to_numpy() == score[mine["vec_id"]]).all()
            want = [i for i in np.lexsort((np.arange(len(v)), -score)) if i != q][:20]
            hits, total = hits + len(set(want) & set(mine["vec_id"])), total + len(want)
    return hits / total


@pytest.mark.parametrize("longest", [1e3, 1e6, 1e25, 1e200])
def test_one_long_vector_costs_no_results(spark, longest):
    v = np.array(common.table(spark, SF, "embeddings", "embedding").toPandas()["embedding"].tolist(), np.float64)
    v[7] *= longest
    assert _recall(spark, v) >= 0.95


def test_unlike_norms(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=(3000, 24)) * r.lognormal(size=3000)[:, None]
    assert _recall(spark, v) >= 0.95 and _recall(spark, v, per_shard=500, block=40) >= 0.95


def test_a_graph_that_reaches_too_little_is_made_up_for(monkeypatch):
    r = np.random.default_rng(8)
    v = r.normal(size=(60, 4))
    g = vector_search.FlatHnsw().build(v)
    monkeypatch.setattr(vector_search.FlatHnsw, "search", lambda self, q, ef: np.full((len(q), ef), -1))
    row, node = vector_search.nearest_nodes(g, v, v[:3], 20, 96)
    assert all(set(node[row == i]) == set(np.argsort(-(v @ v[i]))[:20]) for i in range(3))


@pytest.mark.parametrize("options", [{}, {"per_shard": 200, "block": 20}])
def test_many_equal_vectors_give_their_smallest_ids(spark, options):
    """A third of the rows is one vector: its smallest ids come back, and other queries find their way past it."""
    r = np.random.default_rng(2)
    v = r.normal(size=(900, 8))
    same = np.sort(r.permutation(900)[:300])
    v[same] = 2 * v[0]
    got = vector_search.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"),
                                **options).toPandas()
    ids, hits = np.arange(900), 0
    for q in range(0, 900, 20):
        score = np.einsum("ij,j->i", v, v[q])
        want = [i for i in np.lexsort((ids, -score)) if i != q][:20]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        hits += len(set(want) & set(mine["vec_id"]))
        copies = [i for i in mine["vec_id"] if i in same]
        assert copies == [i for i in same if i != q][:len(copies)]
    assert hits >= 0.97 * 20 * 45


# ---------------------------------------------------------------- 9

def test_main_text():
    page = ('<html><head><title>no</title></head><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>'
            '<div class="content"><h2>T</h2><p>Hi &lt;b&gt; a &amp;  b<p>x < y<div class="ad">buy</div><p>e<i>n</i>d<ul><li>one<li>two</ul>'
            '<form><label>Name</label></form><section id=comments><p>a long reader comment, kept out of the text</section></div><footer>f</footer>')
    assert html_extract.main_text(page) == "T Hi <b> a & b x < y end one two"
    long_ = "a paragraph of plain text that is surely long enough to be a surge of its own, and more"
    assert html_extract.main_text(f"<ul><li><a href=x>m</a></ul><p>{long_}</p><p>s</p><script>var a='</p>'") == f"{long_} s"
    assert [html_extract.main_text(x) for x in (None, "", "<", "<!-- open", "<nav>a</nav>")] == [""] * 5


def test_main_text_is_not_lost_by_names():
    p = "A paragraph of plain text that is surely long enough to be a surge of its own, and more of it."
    for page in (f'<div class="layout has-sidebar"><article><p>{p}</article></div>', f'<div class="menu"><main><p>{p}</main></div>',
                 f'<div class="no-sidebar layout-with-menu"><p>{p}</div>', f'<form><div class="content"><p>{p}</div></form>',
                 f'<div class="content"><p>{p}</div><article><p>A teaser.</article>',
                 f'<article><p>{p}</article><div class="related-posts"><article><p>A teaser.</article></div><aside><article><p>{p}</article></aside>'):
        assert html_extract.main_text(page) == p
    assert html_extract.main_text(f"<article><p>A teaser.</article><p>{p}") == f"A teaser. {p}"
    assert html_extract.main_text(f'<h2 id="search">Search</h2><p>{p}') == f"Search {p}"
    assert html_extract.main_text(f'<p>{p}<p>see <a href=x>a link of some length</a></p><p>{p}') == f"{p} see a link of some length {p}"
    assert html_extract.main_text(f'<div class="main-nav">m</div><p>{p}<p class="cookie-notice">{p}') == p


def test_link_lists_make_a_dive_in_a_marked_region():
    p = "A paragraph of plain text that is surely long enough to be a surge of its own, and more of it."
    links = "<ul>" + "".join(f"<li><a href=x>link {i}</a>" for i in range(4)) + "</ul>"
    assert html_extract.main_text(f"<main>{links}<h2><a href=x>T</a></h2><p>Hi.{links}<p>{p}<p><a href=x>source</a></main>") == f"T Hi. {p} source"
    assert html_extract.main_text(f"<article><p>{p}{links}</article>") == p
    assert html_extract.main_text("<article><p><a href=x>only</a></article>") == "only"


def test_pages(spark):
    got = html_extract.extract_main_text(common.table(spark, SF, "pages", "page_id", "url", "html")).toPandas()
    assert (got["n_chars"] == got["text"].str.len()).all() and (got["n_chars"] > 0).all() and not got["text"].str.contains("©").any()


# ---------------------------------------------------------------- 10

def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents", "doc_id", "text"), common.table(spark, sf, "labels", "doc_id", "quality")
    model = quality.fit(docs, labels)
    got = quality.score_quality(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.93
    odd = quality.score_quality(frame(spark), model).toPandas()
    assert len(odd) == len(ODD) and odd["score"].between(0, 1).all()
    assert [zlib.crc32(str(d).encode()) % 5 == 0 for d in (1, 2, 3)] == odd.set_index("doc_id").loc[[1, 2, 3], "held_out"].tolist()


def test_quality_without_both_classes(spark):
    docs = frame(spark)
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert set(quality.score_quality(docs, quality.fit(docs, none)).toPandas()["score"]) == {0.5}


def test_quality_tasks_have_one_worker_and_few_texts(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2) for i in range(0, 40, 4)], "lid long, y int")
    train = quality.labelled_texts(docs, y, 10)
    assert sorted(r.text for r in train.collect()) == sorted(f"text {i}" for i in range(0, 40, 4))
    assert "BroadcastHashJoin" not in train._jdf.queryExecution().executedPlan().toString()       # its rows go to another Python step

    rng = np.random.default_rng(1)
    sample = [" ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, 200)) for _ in range(600)]
    held = sum(quality.features(t).nbytes for t in sample)
    sign, ratio = np.where(np.arange(600) % 2, 1.0, -1.0), rng.normal(size=1 << 18)
    tracemalloc.start()
    try:
        weights, *_ = quality.fitted(iter(sample), sign, ratio, 18, 1.0, 1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert weights.any() and peak < held + 4 * ratio.nbytes                                       # columns only, no values of them

    class Counted:
        def score(self, text):
            return len(text) / 10

    batch = pa.array(["x" * (i % 7) for i in range(1100)])
    assert list(quality._scores(Counted(), batch, 512)) == [(i % 7) / 10 for i in range(1100)]


def test_quality_fit_writes_no_tables(spark):
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    root = os.path.join(session.checkpoint_dir(spark).replace("file:", ""), "tables")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    model = quality.fit(docs, labels)
    assert model.score("good text") > model.score("bad text")
    assert (set(os.listdir(root)) if os.path.isdir(root) else set()) == before


# ---------------------------------------------------------------- pipeline and empty tables

def test_pipeline_stages_keep_columns_and_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    model = quality.fit(docs, common.table(spark, SF, "labels", "doc_id", "quality"))
    good = steps["quality_classifier"](spark, docs, SF)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect() if model.score(r.text or "") >= 0.3}
    unique = steps["exact_dedup"](spark, good, SF)
    best = {}
    for r in good.collect():
        best[r.text] = max(r.doc_id, best.get(r.text, r.doc_id))
    assert {r.doc_id for r in unique.collect()} == set(best.values()) and unique.columns == docs.columns
    left = steps["ngram_jaccard_join"](spark, unique, SF)
    assert {r.doc_id for r in left.collect()} == {c for _, _, c in _brute([(r.doc_id, r.text) for r in unique.collect()])}
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(packed["doc_id"]) == {r.doc_id for r in left.collect()}


def test_dedup_stages_keep_one_row_of_each_group(spark):
    steps = dict(corpus_pipeline.STAGES)
    near = " ".join(f"w{i}" for i in range(60))
    data = [(7, "a b c"), (7, "a b c"), (7, "one"), (9, "one"), (None, "A A"), (5, "A A"), (None, "B B"), (None, "C"), (None, "C"),
            (11, near), (11, near + " end"), (None, near + " fin"), (12, "other text of its own"), (12, near + " end")]

    def kept(name, rows):
        return sorted(((r.doc_id or 0, r.text) for r in steps[name](spark, frame(spark, rows), SF).collect()))

    unique = [(0, "B B"), (0, "C"), (0, near + " fin"), (5, "A A"), (7, "a b c"), (9, "one"), (11, near), (12, "other text of its own"), (12, near + " end")]
    assert kept("exact_dedup", data) == sorted(unique)
    left = kept("ngram_jaccard_join", data)
    assert [x for x in left if x[1] != near and x[1] != near + " end"] == sorted(
        [(0, "B B"), (0, "C"), (5, "A A"), (7, "a b c"), (7, "one"), (12, "other text of its own")])
    assert len(left) == 7 and left[-2][0] == 11


def test_empty_tables(spark):
    docs = frame(spark).limit(0)
    for f in (sentencepiece_codec.round_trip, exact_dedup.exact_dedup, packing.pack_documents, ngram_join.ngram_join, sharding.shard_documents,
              token_binary.packed_rows):
        assert f(docs).count() == 0


def test_stages_carry_clashing_columns_and_leave_no_tables(spark, tmp_path):
    data = [(i, f"word{i % 7} some text that is long enough to be a sentence {i % 7}", f"r{i}", "f", i) for i in range(30)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, _row string, path string, no int")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for docs in (df, spark.read.parquet(f"{tmp_path}/documents.parquet")):
        with session.scratch(spark):
            first = corpus_pipeline.exact_dedup_stage(spark, docs, "")
            assert first.columns == df.columns and sorted((r.doc_id or -1, r._row or "") for r in first.collect()) == [(-1, ""), *[(i, f"r{i}") for i in range(23, 30)]]
            second = corpus_pipeline.ngram_stage(spark, first, "")
            assert second.columns == df.columns and second.count() == 8
            made = list(session._scratches()[-1])
        root = os.path.join(session.checkpoint_dir(spark).replace("file:", ""), "tables")
        assert made and not {os.path.basename(p) for p in made} & set(os.listdir(root))


# ---------------------------------------------------------------- 9, ordinary markup

FIRST, SECOND = "The first paragraph of the article says something about the valley.", "The second one goes on, with a little more to say."


@pytest.mark.parametrize("page, want", [
    (f'<article title="The hidden valley"><p>{FIRST}</p></article>', FIRST),
    (f"<article data-x='is hidden here'><p>{FIRST}</p><div hidden><p>not this</p></div><p class='hidden'>nor this</p><p style='display : none'>nor</p></article>", FIRST),
    (f'<article><p aria-hidden="true">x y z</p><p>{FIRST}</p></article>', FIRST),
    ("<html><body><p>Short page.</p></body></html>", "Short page."),
    ("<body><p>One short.</p><p>Two short.</p></body>", "One short. Two short."),
    ("<body><nav><a href=x>Home</a></nav></body>", ""),
    *[(f'<article><p>{FIRST}</p><p>{SECOND}</p><{t} {a}><p>I like this article very much, thank you.</p></{t}></article>', f"{FIRST} {SECOND}")
      for t, a in (("div", 'class="reader-comments"'), ("section", 'id="user-comments"'), ("div", 'class="discussion"'), ("div", 'class="advert-unit"'), ("aside", ""))],
    (f'<article class="post comments-open"><p>{FIRST}</p></article>', FIRST),
    (f'<div class="layout has-sidebar"><article class="ad-free"><p>{FIRST}</p></article></div>', FIRST),
    (f"<article><p>{FIRST}</p><ul>" + "".join(f"<li><a href=x>A book about valleys, volume {i}</a></li>" for i in range(5)) + f"</ul><p>{SECOND}</p></article>",
     " ".join([FIRST, *[f"A book about valleys, volume {i}" for i in range(5)], SECOND])),
    (f"<article><p>{FIRST}</p>" + "".join(f"<p><a href=x>Menu {i}</a></p>" for i in range(6)) + "</article>", FIRST)])
def test_ordinary_pages(page, want):
    assert html_extract.main_text(page) == want


def test_deep_pages_take_linear_time():
    import time
    began = time.process_time()
    page = "<b>" + "<div>" * 40_000 + "</b>" * 4_000 + "</span>" * 4_000 + f"<p>{FIRST}</p>" + "</section>" * 4_000
    assert html_extract.main_text(page) == FIRST and html_extract.main_text("<p>" + "<i>" * 20_000 + FIRST) == FIRST
    assert time.process_time() - began < 5


def test_generated_pages_equal_a_second_parser(spark):
    """Pages made of known blocks, read by the standard library's parser: the text of the article's paragraphs, quotes and lists."""
    from html.parser import HTMLParser

    class Second(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.blocks, self.text = [], [], ""

        def inside(self):
            names = [t for t, _ in self.open]
            bad = any(t in ("nav", "aside", "footer", "form", "script") or "comments" in c for t, c in self.open)
            return "article" in names and not bad

        def handle_starttag(self, tag, attrs):
            self.open.append((tag, dict(attrs).get("class", "")))
            self.text = self.text if tag in ("b", "a", "em") else ""

        def handle_data(self, data):
            if self.inside():
                self.text += data

        def handle_endtag(self, tag):
            if tag not in ("b", "a", "em"):
                if self.text.strip() and self.inside():
                    self.blocks.append(" ".join(self.text.split()))
                self.text = ""
            while self.open and self.open.pop()[0] != tag:
                pass

    r = random.Random(12)

    def words(n):
        return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))

    def block():
        kind = r.randrange(6)
        text = f"{words(r.randint(1, 30))} <b>{words(2)}</b> &amp; <em>{words(1)}</em>  {words(5)}"
        return [f"<p>{text}</p>", f"<blockquote><p>{text}</p></blockquote>", f"<ul><li>{text}</li><li>{words(8)}</li></ul>", f"<h2>{words(4)}</h2>",
                f"<aside><p>{words(9)}</p></aside>", f'<div class="reader comments"><p>{words(12)}</p></div>'][kind]

    pages, want = [], {}
    for i in range(60):
        body = "".join(block() for _ in range(r.randint(1, 8))) + f"<p>{words(12)}</p>"
        page = (f"<html><head><title>{words(3)}</title></head><body><nav><ul><li><a href='/'>{words(1)}</a></li></ul></nav><div class='layout'><article>{body}"
                f"<script>var x = '{words(3)}';</script><form><p>{words(4)}</p></form></article></div><footer><p>{words(6)}</p></footer></body></html>")
        second = Second()
        second.feed(page)
        pages.append((i, f"u{i}", page))
        want[i] = " ".join(second.blocks)
    long_ = "<article>" + f"<p>{words(50)}</p>" * 5_000 + "</article>"
    df = spark.createDataFrame([(*p, "t", 1) for p in [*pages, pages[0], (100, None, None), (101, "u", long_), (None, "u", "<p>text of a row without an id</p>")]],
                               "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract_main_text(df).toPandas()
    assert len(got) == 64 and (got["n_chars"] == got["text"].str.len()).all() and list(got.columns) == ["page_id", "url", "text", "n_chars"]
    assert {x.page_id: x.text for x in got.itertuples() if x.page_id < 60} == want
    assert got[got["page_id"] == 101]["n_chars"].iloc[0] > 1_000_000 and got[got["page_id"] == 100]["text"].iloc[0] == ""
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 5 and 7, odd tables

def test_urls_of_listed_hosts_without_a_path_and_odd_rows(spark):
    pages = spark.createDataFrame([(1, "x://ads.example.org?q"), (2, "x://ads.example.org#f"), (3, "x://sub.ads.example.org"), (3, "x://sub.ads.example.org"),
                                   (None, "x://ads.example.org/" + "p" * 200_000), (5, "x://example.org")], "page_id long, url string")
    got = [(r.page_id, r.verdict) for r in url_filter.filter_urls(pages, url_filter.listed_hosts(pages)).collect()]
    assert sorted(got, key=str) == [(1, "block"), (2, "block"), (3, "block"), (3, "block"), (5, "allow"), (None, "block")]
    assert url_filter.filter_urls(pages.limit(0), url_filter.listed_hosts(pages)).count() == 0


def test_shards_of_repeated_rows_and_null_ids(spark):
    """One id, or none, holds a third of the rows: sizes stay near equal, slots gapless."""
    data = [(None, f"text {i % 40}") for i in range(400)] + [(7, "same")] * 400 + [(100 + i, f"own {i}") for i in range(400)]
    df = spark.createDataFrame([(*d, "x", 1) for d in data], "doc_id long, text string, shard string, row int").repartition(6)
    got = sharding.shard_documents(df).toPandas()
    assert len(got) == len(data) and list(got.columns) == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    loads = got.groupby("shard")["size"].sum()
    assert len(loads) == 16 and loads.max() - loads.min() <= 2 * got["size"].max()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_sharding_cuts_fewer_links_than_a_hash(spark):
    data = [(i, f"group {i % 60}") for i in range(600)] + [(1000 + i, "alone " * (i % 7) + str(i)) for i in range(600)]
    got = sharding.shard_documents(spark.createDataFrame(data, "doc_id long, text string")).toPandas()
    split = got[got["doc_id"] < 1000].groupby("text_crc32")["shard"].nunique()
    assert (split == 1).mean() > 0.5                        # by a hash of ten ids each, nearly none would be whole


# ---------------------------------------------------------------- 3, certificates

def _fewest(lengths, size):
    """Fewest bins, by trying every place of every piece."""
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1:])
        place(i + 1, [*rooms, size - lengths[i]])

    place(0, [])
    return best[0]


def test_certified_packings_are_optimal():
    r, certified = random.Random(4), 0
    for _ in range(300):
        n = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        _, _, used = packing.best_fit_decreasing(np.array(n), 20)
        bound, fewest = packing.lower_bound(np.bincount(n, minlength=21), 20), _fewest(n, 20)
        assert bound <= fewest <= used <= fewest + 1
        if bound == used:
            certified += 1
            assert used == fewest
    assert certified > 200


def _packed(spark, lengths, size, per_part, monkeypatch):
    rows = [(i, 0, 0, n, i) for i, n in enumerate(lengths)]
    pool = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    rounds, real = [], packing._pack_round
    monkeypatch.setattr(packing, "_pack_round", lambda p, parts, k, s: (rounds.append((k, parts, p.count())), real(p, parts, k, s))[1])
    got = packing.pack_pieces(pool, np.bincount(lengths, minlength=size + 1), size, per_part).toPandas()
    assert sorted(got["doc_id"]) == list(range(len(lengths)))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= size and (g["offset"] == g["length"].cumsum() - g["length"]).all()
    return got["sequence_id"].nunique(), rounds


def test_only_open_partitions_exchange(spark, monkeypatch):
    halves, rounds = _packed(spark, [50] * 400, 100, 50, monkeypatch)       # each partition is at its bound; odd ones leave a half each
    assert halves == 200 and all(n <= 8 for _, _, n in rounds[1:])
    mixed = [random.Random(i).randint(1, 60) for i in range(900)]
    got, rounds = _packed(spark, mixed, 100, 100, monkeypatch)
    bound = packing.lower_bound(np.bincount(mixed, minlength=101), 100)
    alone = packing.best_fit_decreasing(np.array(mixed), 100)[2]
    assert bound <= got <= alone + 1 and rounds[0][1] == 9 and all(b[2] < a[2] for a, b in zip(rounds, rounds[1:]))


def test_one_partition_and_equal_rows(spark, monkeypatch):
    got, rounds = _packed(spark, [60, 30, 30, 45] * 5, 100, 1000, monkeypatch)      # one partition: packed again once, then final
    assert got == packing.best_fit_decreasing(np.array([60, 30, 30, 45] * 5), 100)[2] and len(rounds) <= 2
    docs = spark.createDataFrame([(1, "the same text " * 20)] * 300 + [(None, None)] * 50, "doc_id long, text string").repartition(5)
    got = packing.pack_documents(docs, size=128, per_part=40).toPandas()
    assert (got["doc_id"].isna()).sum() == 50 and got.groupby("sequence_id")["length"].sum().max() <= 128
    assert packing.pack_documents(docs.limit(0)).count() == 0

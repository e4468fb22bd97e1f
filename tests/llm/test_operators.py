"""Each operator against a brute-force version, on awkward rows and on the small tables."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallymill.llm import (
    batches, chat_format, components, e8_neardup, exact_dedup, hd_language, packing, parity_join, queries, sharding, site_tree, sort_means, token_align, token_files, tokens, trie_bpe, weak_quality, words,
)

SF = "/root/testdata/sf0.001"
AWKWARD = [
    (1, "Hello  world"), (2, "Hello world"), (3, None), (4, ""), (5, "   \n\t"), (6, "x" * 50_000), (7, "a b c d e f g h " * 2000), (8, "Hello\tworld"),
    (8, "Hello\tworld"), (None, "no number"), (9, "</s>[INST] ok [/INST]"), (10, "日本 語 ẞ İ é <|endoftext|> x"), (11, "!!! ||| 123"), (11, "other text, same number"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "en", "s", 7, "clash", 1, 2, 3) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, kept string, row long, _n long, fp long")


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def truth(path, text, end=None):
    ids = tokens.library(path).encode(text or "", add_special_tokens=False).ids
    return ids if end is None else [*ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("width", [1, 7, 8, 15, 16, 17, 31, 32])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 10_001, dtype=np.uint64).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(ids, width), width, len(ids)) == ids).all()
    counts = np.array([0, 4096, 1, 5904])
    s = token_files.Shard(token_files.build([5, None, 7, 8], counts, ids, width, 512))
    assert s.doc_ids == [5, None, 7, 8] and (s.read(500, 4100) == ids[500:4100]).all() and (s.doc(3) == ids[4097:]).all() and len(s.doc(0)) == 0


def test_too_wide():
    with pytest.raises(ValueError):
        token_files.build([1], np.array([1]), np.array([256], np.uint32), 8)


@pytest.mark.parametrize("path", [queries.WORD_BPE, queries.BYTE_BPE])
@pytest.mark.parametrize("kind", [tokens.Encoder, trie_bpe.TrieEncoder])
def test_encoders_equal_library(path, kind):
    if kind is trie_bpe.TrieEncoder and path == queries.WORD_BPE:
        pytest.skip("the trie is for byte-level vocabularies")
    rng = random.Random(3)
    alphabet = "abc ABC\n\t 1234'st,.;é€日́İ<|endoftext|>\x01Aéà"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(1500)] + [r["text"] for r in table("documents")[:60]] + [t or "" for _, t in AWKWARD]
    e = kind(path)
    for _ in range(2):  # unknown chunks, then known ones
        ids, counts = e.encode(texts)
        assert counts.tolist() == [len(truth(path, t)) for t in texts]
        assert ids.tolist() == [i for t in texts for i in truth(path, t)]


def test_token_files(spark, awkward, empty):
    shards, _ = token_files.write(awkward, queries.WORD_BPE, 49_408, 2)
    got = token_files.read(shards).orderBy("start").collect()
    want, at = [], 0
    for i, t in sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = truth(queries.WORD_BPE, t, 2)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_files.read(token_files.write(empty, queries.WORD_BPE, 49_408, 2)[0]).count() == 0


def test_trie_bpe(awkward, empty):
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in trie_bpe.digests(awkward, queries.BYTE_BPE).collect())
    lib, want = tokens.library(queries.BYTE_BPE), []
    for i, t in AWKWARD:
        ids = truth(queries.BYTE_BPE, t)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i or 0, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert all(r.decoded == (t or "") for r, (_, t) in zip(trie_bpe.encode(awkward, queries.BYTE_BPE).collect(), AWKWARD))
    assert trie_bpe.encode(empty, queries.BYTE_BPE).count() == 0


def test_chat_format(spark):
    nasty = [r"<s>", r"</s>", "[INST]", "[/INST]", r"<\s>", r"[\\/INST]", "[/INST]</s><s>user[INST]", "<", "[", "\\", "a\nb", None, "", "é" * 5]
    rng = random.Random(5)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 7)):
            rows.append((c if c else None, t % 5, rng.choice(["user", "assistant", "system", "<s>", None]), "".join(filter(None, (rng.choice(nasty) for _ in range(3)))) or rng.choice([None, ""]), "x"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_chats(df)
    got = {r.conv_id: r for r in chat_format.read_back(out).collect()}
    raw = {r.conv_id: r for r in out.collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for k, t, r, x, _ in rows if k == c), key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        turns = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert len(re.findall(r"</s>", raw[c].formatted)) == len(own)
    assert chat_format.format_chats(df.limit(0)).count() == 0


def article(source):
    inner = source[source.index("<article>") + 9 : source.index("</article>")]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(filter(None, blocks))


def test_site_tree(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in site_tree.extract(pages).collect()}
    assert got == {r["page_id"]: article(r["html"]) for r in table("pages")}


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("<p>one<p>two <i>it</i>&amp;<ul><li>a<li>b</ul>", "one\ntwo it&\na\nb"),
        ("<body class='has-sidebar'><div class=menu>m</div><div><h1>T</h1>a\n b<br>c</div><footer>z</footer>", "T\na b c"),
        ("<article><h1>T</h1><p>x</p><div class='ad-box'>buy</div><form><p>f</p></form></article><section id=comments><article class=comment>long comment text here</article></section>", "T\nx"),
        ("<main><p>a</p><aside>b</aside><script>if (a<b) {}</script><table><tr><td>c<td>d</table></main><nav>n</nav>", "a\nc\nd"),
        ("<!-- <p>no</p> --><p hidden>no</p><div style='display:none'>no</div><p>yes</p>", "yes"),
        ("a < b", "a < b"),
        ("<form><div class=nav>n</div><article><p>in a form</p></article><form><p>search</p></form></form>", "in a form"),
        ("<form id=page><div>long enough to be the page itself</div></form><form>f</form>", "long enough to be the page itself"),
        ("<p>E <math><mi>m</mi><mi>c</mi></math></p>", "E mc"),
    ],
)
def test_page(source, text):
    assert site_tree.Page(source).main_text({}) == text


def test_site_tree_learns_what_repeats(spark):
    rows = [(k, "http://h.example/x", f"<div><div class=q1>same strip</div><div class=q2><p>text {k} {k * 7}</p></div></div>") for k in range(30)] + [(90, None, None), (91, "nonsense", "<p>t</p>"), (91, "nonsense", "<p>t</p>")]
    got = site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted([(k, f"text {k} {k * 7}") for k in range(30)] + [(90, ""), (91, "t"), (91, "t")])
    assert site_tree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_site_tree_learns_below_many_levels(spark):
    deep = lambda x: "<div>" * 20 + x + "</div>" * 20
    rows = [(k, f"http://deep.example/{k}", deep(f'<div class="a">Same words on every page</div><div class="b"><p>Story number {k} of its own</p></div>')) for k in range(12)]
    got = site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: f"Story number {k} of its own" for k in range(12)}


def test_chats_with_long_texts_and_clashing_columns(spark):
    long = "<s>[INST] word " * 150_000
    rows = [(1, 0, "user", long, "x", 1, "y"), (1, 1, "assistant", long, "x", 1, "y"), (1, 1, "assistant", long, "x", 1, "y"), (None, None, None, None, "x", 1, "y")]
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, r string, t long, piece string"))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 * len(long) and got[1].loss_sha256 == hashlib.sha256((long * 2).encode()).hexdigest()
    assert got[None].n_turns == 1 and got[None].loss_chars == 0


def lows(pages):
    """The tree's low importances of each page, by its key."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"), F.xxhash64("url", F.coalesce("html", F.lit(""))).alias("key"))
    return [(r.page_id, r.html, {x.path: x.importance for x in r.low or ()}) for r in rows.join(site_tree.trees(rows), "key", "left").collect()]


def test_tree_alone_removes_what_no_name_tells(spark):
    """Hosts without <article> and without telling names: menus, notices and a ticker of few contents go by importance, nested ones with their branch."""
    words_of = lambda k, n: " ".join(f"w{(k * 7919 + j * 104729) % 5003}" for j in range(n))
    page = lambda k: (
        f"<div class=x1><div class=x2><p>Home</p><p>About us</p></div><div class=x3><p>Ticker {k % 3}</p></div></div>"
        f"<div class=x4><p>{words_of(k, 40)}</p><div class=x5><p>{words_of(k + 500, 30)}</p></div><div class=x6><p>Share this story</p></div></div><div class=x7><div><div>All rights kept</div></div></div>"
    )
    rows = [(k, f"https://plain.example/{k}", page(k)) for k in range(60)]
    found = lows(spark.createDataFrame(rows, "page_id long, url string, html string"))
    total = 0
    for k, html_, low in found:
        removed = []
        assert site_tree.Page(html_).main_text(low, removed) == f"{words_of(k, 40)}\n{words_of(k + 500, 30)}"
        assert removed == ["Home", "About us", f"Ticker {k % 3}", "Share this story", "All rights kept"]
        assert site_tree.Page(html_).main_text({}).count("\n") == 6  # the rules alone keep all of it
        total += len(removed)
    assert total == 300


def test_tree_leaves_articles_of_the_tables_alone(spark):
    """The tables' menus, adverts and footers differ from page to page, so their trees find little and the rules decide."""
    removed = []
    for _, html_, low in lows(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")):
        assert site_tree.Page(html_).main_text(low, removed) == article(html_)


def test_importance_by_definition(spark):
    """Entropies of presentations and contents as shares of the largest possible; the branch's mean by text."""
    rows = [(k, "http://h/", f"<div><p>{'same' if k < 6 else k}</p><div class=u>{k}</div></div>") for k in range(8)]
    host_rows = spark.createDataFrame(rows, "key long, host string, html string")
    got = sorted(r.importance for r in site_tree.importances(site_tree.parsed(host_rows)).collect())
    h = -(6 / 8 * np.log(6 / 8) + 2 * (1 / 8) * np.log(1 / 8)) / np.log(8)
    assert np.allclose(got, [h, 1.0])
    page = site_tree.Page("<div>abcd<div class=u>xy</div><div class=v>pq</div></div>")
    composed, most = page.branches({page.nodes[0].path: 0.25, page.nodes[1].path: 1.0, page.nodes[2].path: 0.5})
    assert np.allclose(composed, [(4 * 0.25 + 2 * 1 + 2 * 0.5) / 8, 1, 0.5]) and most[0] == 1


@pytest.mark.parametrize("source", ['<a "' * 100_000, "<div>" * 100_000 + "deep", "<b><div>" * 30_000 + "</b>" * 30_000, "<i>" * 100_000 + "</p>" * 100_000, "<p><table><tr>" * 20_000, "<!--" * 50_000, "<a b='" * 60_000, "<script>" * 60_000, "</x>" * 100_000, "<" * 200_000])
def test_hostile_pages_take_linear_time(source):
    import time

    start = time.process_time()
    page = site_tree.Page(source)
    list(page.contents())
    page.main_text({0: 1.0})
    assert time.process_time() - start < 10


def test_site_tree_with_clashing_columns_and_long_pages(spark):
    rows = [(1, "http://h/1", "<article><p>" + "word " * 200_000 + "</p></article>", "x", 5, "y", []), (2, "http://h/2", "<div>" * 3000 + "inner" + "</div>" * 3000, "x", 5, "y", [1])] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, key long, low string, paths array<long>")
    assert sorted((r.page_id, len(r.text)) for r in site_tree.extract(df).collect()) == [(1, 999_999)] * 2 + [(2, 5)] * 2


def test_quotient_filter():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) % 3000 * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
    f = exact_dedup.QuotientFilter.build(a).merge(exact_dedup.QuotientFilter.build(b))
    both = np.concatenate([a, b])
    values, counts = np.unique(both, return_counts=True)
    assert (f.prints() == values).all() and (f.counts == counts).all() and f.count(int(values[3])) == counts[3] and f.count(12345) == 0


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_filters_of_ranges_merge_without_loss(spark, monkeypatch):
    """Filters of many partitions, cut into ranges and merged again, against plain counts."""
    monkeypatch.setattr(exact_dedup, "RANGE", 500)
    monkeypatch.setattr(exact_dedup, "CAPACITY", 700)
    prints = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 4000)[np.random.default_rng(3).zipf(1.3, 9000) % 4000]
    values, counts = np.unique(prints, return_counts=True)
    got = exact_dedup.repeated(spark.createDataFrame([(int(x),) for x in prints], "fp long").repartition(7)).collect()
    assert sorted((r.fp, r.n) for r in got) == sorted((int(v), int(n)) for v, n in zip(values, counts) if n > 1)
    f = exact_dedup.QuotientFilter.build(prints.view(np.uint64), bits=12)
    merger = exact_dedup.Merger()
    parts = {k: exact_dedup.QuotientFilter.of_range(2, *own) for k, *own in f.ranges(2)}
    assert [x for k, own in parts.items() for x in (own.prints() | np.uint64(k << 62)).tolist()] == values.view(np.uint64)[np.argsort(values.view(np.uint64))].tolist()
    for x in (0, 3, 1):
        merger.add(parts[x % 2])
    whole = merger.whole()
    assert whole.counts.sum() == 2 * parts[1].counts.sum() + parts[0].counts.sum()


@pytest.mark.parametrize("told", [1 << 19, 5])
def test_only_candidates_are_shuffled(spark, monkeypatch, told):
    """Whether prints or their bits are told, with broadcasts off texts without a repeated print stay where they are, and groups are right."""
    monkeypatch.setattr(exact_dedup, "TOLD", told)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") % 10 == 0, F.col("id") % 40).otherwise(F.col("id"))).alias("text")).repartition(5)
        texts = docs.select("doc_id", exact_dedup.normalised(F.col("text")).alias("norm"))
        path = f"{exact_dedup.scratch.root(spark)}/flagged-{told}"
        docs.where("doc_id % 10 = 0").select(F.xxhash64("text").alias("fp")).distinct().unionByName(spark.range(10).select(F.xxhash64(F.col("id").cast("string")).alias("fp"))).write.mode("overwrite").parquet(path)
        found = exact_dedup.candidates(texts, spark.read.parquet(path))
        assert sorted(r.doc_id for r in found.collect()) == list(range(0, 3000, 10))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) and ("SortMergeJoin" in plan) == (told == 5)
        rows = exact_dedup.groups(docs).collect()
        assert all(r.group_size == (75 if r.doc_id % 10 == 0 else 1) and r.keep_id == (r.doc_id % 40 if r.doc_id % 10 == 0 else r.doc_id) for r in rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exact_dedup(awkward, empty):
    by = {}
    for i, t in AWKWARD:
        by.setdefault(norm(t), []).append(i)
    want = []
    for i, t in AWKWARD:
        ids = by[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        want.append((i or 0, keep or 0, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted((r.doc_id or 0, r.keep_id or 0, *r[2:]) for r in exact_dedup.groups(awkward).collect()) == sorted(want)
    kept = exact_dedup.deduplicated(awkward)
    assert kept.columns == awkward.columns and sorted(norm(r.text) for r in kept.collect()) == sorted(by)
    assert exact_dedup.groups(empty).count() == 0 and exact_dedup.deduplicated(empty).count() == 0


def shingle_set(t):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate(low)) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 4 * len(x & y) >= 3 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), (True, 0)), (i is None, i or 0))
    return sorted((i or 0, len(s), least[find(k)][1]) for k, (i, s) in enumerate(sets))


def variants(seed, n):
    """Documents around the threshold: copies of a few bases with some words changed, of all small sizes."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for k in range(n):
        if k % 6 == 0:
            base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 7, 8, 9, 12, 20, 40, 70, 150, 300]))]
        own = list(base)
        for _ in range(rng.randrange(0, max(2, len(own) // 25 + 2))):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        out.append((k, " ".join(own) + (" Shared Tail Of Six Words Here" if k % 5 == 0 else "")))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_parity_join(spark, seed):
    rows = variants(seed, 240) + AWKWARD
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in parity_join.groups(docs).collect())
    assert got == brute_components(rows)


def test_hot_blocks_are_split_without_loss(spark):
    docs = spark.createDataFrame([(i, t) for i, t in variants(3, 150)], "doc_id long, text string")
    pairs = lambda hot: {(r.a, r.b) for r in parity_join.meetings(docs, 3, hot).select("sid", "members").mapInArrow(parity_join._members, "sid long, id long").alias("x").transform(
        lambda m: m.alias("x").join(m.alias("y"), (F.col("x.sid") == F.col("y.sid")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))).collect()}
    whole = pairs(1 << 30)
    assert whole and all(pairs(h) >= whole for h in (1, 2, 5))
    met = parity_join.meetings(docs, 3, 2)
    assert not met.where("portion").isEmpty()
    star = {(r.a, r.b) for r in parity_join.stars(met).collect()}
    assert {r.a for r in parity_join.stars(parity_join.meetings(docs, 3, 1 << 30)).collect()} <= {x for p in star for x in p}


def test_parity_join_dedup(awkward, empty):
    kept = parity_join.deduplicated(awkward).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted((i or 0, t or "") for i, t in dict.fromkeys(AWKWARD) if not (i in (2, 8)))
    assert parity_join.groups(empty).count() == 0 and parity_join.deduplicated(empty).count() == 0


@pytest.mark.parametrize("fine", [0, -1])
def test_block_keys_meet_every_similar_pair(fine):
    rng = np.random.default_rng(7)
    for n in [*range(1, 80), 127, 128, 129, 255, 256, 300, 511, 512, 700]:
        for _ in range(4):
            common = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            spare = int((n + n) / 7) + 1
            extra = int(rng.integers(0, spare))
            a, b = common[: n - extra // 2], np.concatenate([common[extra - extra // 2 :], rng.integers(0, 1 << 64, int(rng.integers(0, 2)), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            i = len(np.intersect1d(a, b))
            if not i or 4 * i < 3 * (len(a) + len(b) - i):
                continue
            who, keys, short = parity_join.block_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), fine)
            assert not short and set(keys[who == 0].tolist()) & set(keys[who == 1].tolist()), n


def test_bands_short_of_blocks_are_told(spark, monkeypatch):
    """With far too few blocks the pigeonhole argument fails; the bands' sets are then found by single shingles."""
    monkeypatch.setattr(parity_join, "PER_BLOCK", 100.0)
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 200, dtype=np.uint64))
    assert parity_join.block_keys(h, np.array([200]))[2] == 3 << 7 and parity_join.block_keys(h, np.array([200]), 3 << 7)[2] == 0


def test_links_told_are_fewer_than_rows():
    """A group of close sets of single components tells a spanning tree, and exactly its links count."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 100, dtype=np.uint64)
    sets = [np.sort(np.concatenate([base[: 100 - k % 9], rng.integers(0, 1 << 64, k % 9, dtype=np.uint64)])) for k in range(300)]
    t = pa.table({"sid": [1] * 300, "deal": [0] * 300, "id": list(range(300)), "comp": list(range(300)), "set": [x.tobytes() for x in sets]})
    told = [p for b in parity_join._joining(iter(t.to_batches(max_chunksize=64))) for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
    assert len(told) == 299 and all(4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b])) for a, b in told)


def test_sketch_bounds_difference():
    rng = np.random.default_rng(8)
    for n, m in [(10, 12), (100, 90), (300, 500)]:
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, m - n // 2, dtype=np.uint64)]))
        x, y = (np.frombuffer(s, np.uint64) for s in parity_join.sketches(np.concatenate([a, b]), np.array([len(a), len(b)])))
        size = min(len(x), len(y))
        apart = int(np.bitwise_count(parity_join._folded(x, size) ^ parity_join._folded(y, size)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_packing(awkward, empty, spark):
    docs = awkward.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", F.lit(7).cast("long").alias("n"), F.lit("x").alias("kept"), *[F.lit(1).cast("long").alias(c) for c in ("row", "_n", "fp")]).withColumn("doc_id", F.col("doc_id") + 1000))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pieces = packing.pack(docs, queries.BYTE_BPE, 0).collect()
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    for own in by.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        total = sum(p.length for p in own)
        assert total == 1024 or total < 1024 and total & (total - 1) == 0
    ids = [truth(queries.BYTE_BPE, t, 0) for _, t in rows]
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    for i, t in rows:
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        if [r[0] for r in rows].count(i) == 1:
            whole = truth(queries.BYTE_BPE, t, 0)
            assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and {p.doc_tokens for p in own} == {len(whole)}
            assert all(p.ids_crc32 == crc(whole[p.start : p.start + p.length]) for p in own)
    assert packing.pack(empty, queries.BYTE_BPE, 0).count() == 0


def test_packing_prefers_neighbours():
    own = [[1, 2, 3, 4], [9, 9], [1, 2, 3, 4], [8, 8]]
    ids, counts = np.array([i for x in own for i in [*x, 0]], np.uint16), np.array([len(x) + 1 for x in own])
    index = packing.Index(ids, counts, packing.Corpus(np.full(packing.IDS + packing.PAIRS, 2), 100, 300))
    pieces = packing.fill(np.array([600, 400, 400, 424]), index)
    assert [p[0] for p in pieces if p[3] == 0][:2] == [0, 2]


def pairs_too(own):
    """The terms of a list of ids by definition: ids, and hashed pairs of neighbours."""
    pair = lambda a, b: packing.IDS + (((a * 0x9E3779B1 & 0xFFFFFFFF ^ b) * 0x85EBCA77 & 0xFFFFFFFF) >> 12)
    return [*own, *(pair(a, b) for a, b in zip(own, own[1:]))]


@pytest.mark.parametrize("dense", [2, 10, 1000])
def test_bm25_by_definition(monkeypatch, dense):
    """Scores, and the order of neighbours with ties, against sums over the documents' own terms."""
    monkeypatch.setattr(packing, "DENSE", dense)
    monkeypatch.setattr(packing, "BLOCK", 16)
    rng = np.random.default_rng(6)
    own = [rng.zipf(1.5, int(rng.integers(0, 60))).clip(1, 40).tolist() for _ in range(50)]
    own[7] = list(own[3])
    ids, counts = np.array([i for x in own for i in [*x, 0]], np.uint32), np.array([len(x) + 1 for x in own])
    own = [pairs_too(x) for x in own]
    df = np.zeros(packing.IDS + packing.PAIRS, np.int64)
    for x in own:
        df[sorted(set(x))] += 5
    n_docs, n_terms = 500, 9000
    index = packing.Index(ids, counts, packing.Corpus(df, n_docs, n_terms))

    def bm25(seed, d):
        total = 0.0
        for t in set(own[seed]) & set(own[d]):
            tf = own[d].count(t)
            if seed != d or df[t] > 5:
                total += np.log(1 + (n_docs - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own[d]) / (n_terms / n_docs)))
        return total

    for seed in range(50):
        want = [bm25(seed, d) for d in range(50)]
        assert np.allclose(index.scores(seed), want, rtol=1e-5)
        unused = np.arange(50) != seed
        near = index.neighbours(seed, unused).tolist()
        assert set(near) == {d for d in range(50) if want[d] > 0 and d != seed}
        assert all(want[a] > want[b] - 1 / 512 for a, b in zip(near, near[1:]))
        if {3, 7} <= set(near):
            assert near.index(3) < near.index(7)


def test_packing_finds_neighbours_wherever_they_stand(spark):
    rng = random.Random(4)
    rows = [(k, " ".join([f"topic{k % 1500}w{j}" for j in range(12)] * 7 + [f"plain{rng.randrange(300)}" for _ in range(20)])) for k in range(3000)]
    held = {}
    for p in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), queries.BYTE_BPE, 0).collect():
        held.setdefault(p.doc_id, set()).add(p.sequence_id)
    assert np.mean([bool(held[k] & held[k + 1500]) for k in range(1500)]) > 0.5


def test_document_frequencies_are_exact(awkward, spark):
    docs = awkward.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")).repartition(5)
    df, n_docs, n_terms = packing.frequencies(packing.encoded(docs, queries.BYTE_BPE, 0)[0])
    ids = [truth(queries.BYTE_BPE, r.text) for r in docs.collect()]
    want = np.zeros(len(df), np.int64)
    for x in ids:
        want[sorted(set(pairs_too(x)))] += 1
    assert (df == want).all() and n_docs == len(ids) and n_terms == sum(len(pairs_too(x)) for x in ids)


def test_language(spark, awkward, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in hd_language.identify(docs).collect()}
    rows = table("documents")
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert {r["doc_id"] for r in held} == {i for i, r in got.items() if r.held_out}
    assert np.mean([got[r["doc_id"]].lang_pred == r["lang"] for r in held]) > 0.95
    odd = [(r.doc_id, r.lang_pred, r.score) for r in hd_language.identify(awkward).collect()]
    assert all(0 <= s <= 1 for _, _, s in odd) and sum(p == "und" for _, p, _ in odd) == 4
    assert {3, 4, 5} <= {i for i, p, _ in odd if p == "und"}
    assert hd_language.identify(empty).count() == 0 and hd_language.keep(empty).count() == 0


def test_language_of_few_words(spark):
    codes = np.random.default_rng(5).choice([0, *range(97, 123), *map(ord, "àéñüßøжшяא漢語")], (400, 3))
    grams = codes[:, 0] << 2 * hd_language.BITS | codes[:, 1] << hd_language.BITS | codes[:, 2]
    v = hd_language.bound(np.unique(grams))
    cos = v @ v.T / v.shape[1]
    assert np.abs(cos[~np.eye(len(v), dtype=bool)]).mean() < 0.025  # all but orthogonal
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL")
    model = hd_language.learn(docs.where(~hd_language.held_out()))
    few = docs.where(hd_language.held_out()).withColumn("text", F.concat_ws(" ", F.slice(F.split("text", " "), 1, 2)))
    got = hd_language.identify(few, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.92


def test_unlearned_languages_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(6)
    junk = lambda first, n: " ".join("".join(chr(first + rng.integers(n)) for _ in range(rng.integers(2, 9))) for _ in range(60))
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
        *[junk(97, 26) for _ in range(20)],
        *[junk(0x430, 32) for _ in range(20)],
    ]
    more = spark.createDataFrame([(-k - 1, t, None) for k, t in enumerate(foreign)], "doc_id long, text string, lang string")
    left = {r.doc_id for r in hd_language.keep(docs.unionByName(more)).select("doc_id").collect()}
    assert not [i for i in left if i < 0]
    clean = {r["doc_id"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist() if r["quality"] == 1}
    assert len(clean & left) >= 0.995 * len(clean)


def test_binding_by_definition():
    x, y, z = map(ord, "ažc")
    a, b, c = (hd_language.letter(k).astype(float) for k in (x, y, z))
    assert (hd_language.bound(np.array([x << 2 * hd_language.BITS | y << hd_language.BITS | z]))[0] == np.roll(a, 2) * np.roll(b, 1) * c).all()
    assert abs(hd_language.letter(0x6F22).astype(int) @ hd_language.letter(0x8A9E)) < 300  # each letter its own vector


@pytest.mark.parametrize("parts", [3, 7])
def test_language_by_definition(spark, parts):
    """Predictions and scores against trigram vectors bound, bundled and compared one by one."""
    rows = [(r["doc_id"], r["text"][:300], r["lang"]) for r in table("documents")[:60]] + [(1000, "漢字 かな 漢字", "ja"), (1001, "Привет мир", "ru"), (1002, "漢字 かな", None), (1003, "мир", None), (1004, None, None), (1005, "12 !", "en")]

    def vector(text):
        chars = [c if c.isalpha() else " " for c in f" {text.lower()} "]
        chars = [c for k, c in enumerate(chars) if c != " " or k == 0 or chars[k - 1] != " "]
        letters = [hd_language.letter(0 if c == " " else ord(c)).astype(float) for c in chars]
        total, n = np.zeros(hd_language.SIZE), 0
        for k in range(len(letters) - 2):
            if chars[k : k + 3] != [" "] * 3:
                total += np.roll(letters[k], 2) * np.roll(letters[k + 1], 1) * letters[k + 2]
                n += 1
        return total, n

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    prototypes = {}
    for i, t, lang in rows:
        if t is not None and lang is not None and not held(i) and (v := vector(t))[1]:
            prototypes[lang] = prototypes.get(lang, 0) + v[0] / v[1]
    want = {}
    for i, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t):
            want[i] = ("und", 0.0)
            continue
        v = vector(t)[0]
        cos = {lang: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for lang, p in prototypes.items()}
        best = max(sorted(cos), key=cos.get)
        want[i] = (best, max(0.0, cos[best]))
    got = hd_language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: p for i, (p, _) in want.items()} and all(abs(r.score - want[r.doc_id][1]) < 1e-4 for r in got)


def test_quality(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    got = {r.doc_id: r.kept for r in weak_quality.score(docs).collect()}
    good = [got[i] for i, q in labels.items() if q == 1]
    bad = [not got[i] for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) > 0.8
    odd = [(r.doc_id, r.quality_score, r.kept) for r in weak_quality.score(awkward).collect()]
    assert len(odd) == len(AWKWARD) and all(not k and s == 0 for i, s, k in odd if i in (3, 4, 5))
    assert weak_quality.keep(awkward).columns == awkward.columns
    assert weak_quality.score(empty).count() == 0 and weak_quality.keep(empty).count() == 0


def test_quality_sample_holds_copies_by_their_share(spark, monkeypatch):
    rows = [(k, f"Document number {k} tells a story of its own.") for k in range(2000)]
    sizes, real = [], weak_quality.smoothed
    monkeypatch.setattr(weak_quality, "smoothed", lambda x, n, mean: (sizes.append(n), real(x, n, mean))[1])
    for word in ("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"):  # the text's own digest falls this way or that
        hot = [(5000 + k, f"The one text that everyone copies is far longer than the others, {word} as ever and ever.") for k in range(1000)]
        weak_quality.train(spark.createDataFrame(rows + hot, "doc_id long, text string"), 300)
        assert len(sizes[-1]) == 300 and 60 <= (sizes[-1][:, 0] > 60).sum() <= 140


def test_few_plain_sentences_stay(spark):
    rows = [(1, None), (2, ""), *[(k, "The river runs slowly past the old mill, and nobody minds.") for k in (3, 4, 5)], (6, "She wrote to him in spring. He answered in autumn."), (7, "!!! ||| $$$ ||| !!! BUY NOW !!! $$$"), (8, "A short one."), (9, "Bread, salt and water were all they had left.")]
    got = {r.doc_id: r.kept for r in weak_quality.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, k in got.items() if not k] == [1, 2, 7]


def test_posterior_by_definition():
    """The fixed point of expectation-maximisation, pattern by pattern."""
    rng = np.random.default_rng(12)
    patterns = np.unique(rng.integers(0, 3, (40, 4)), axis=0)
    counts = rng.integers(1, 60, len(patterns)).astype(float)
    p = weak_quality.posterior(patterns, counts, 2000)
    counts[(patterns == 0).all(1)] = 0
    share, strength = (1 - weak_quality.BAD_SHARE, weak_quality.BAD_SHARE), weak_quality.STRENGTH
    again = []
    w = {0: counts * (1 - p), 1: counts * p}
    for row in patterns:
        odds = {}
        for c in (0, 1):
            odds[c] = (w[c].sum() + strength * share[c]) / (counts.sum() + strength)
            for v, vote in enumerate(row):
                if vote:
                    cast = w[c][patterns[:, v] > 0].sum() + strength
                    odds[c] *= (w[c][patterns[:, v] == vote].sum() + strength * weak_quality.EXPECTED[c][vote - 1]) / cast
        again.append(odds[1] / (odds[0] + odds[1]))
    assert np.allclose(again, p, atol=1e-5)


def test_few_documents_are_judged_by_the_same_model():
    """Twenty documents, then a thousand times as many: one bad vote of many condemns none, most votes bad do, at either size."""
    patterns = np.array([[1] * 8, [1, 2, 1, 1, 1, 1, 1, 1], [2, 2, 2, 0, 2, 2, 2, 1]])
    for times in (1, 1000):
        assert (weak_quality.posterior(patterns, times * np.array([16.0, 1, 3])) > 0.5).tolist() == [False, False, True]
    assert (weak_quality.posterior(np.array([[0] * 8, [2, 2, 2, 2, 1, 1, 0, 0]]), np.array([5.0, 1])) > 0.5).tolist() == [False, True]


def test_classes_of_code_points():
    text = "aÉ7 \n.。！,—漢かไ中𠀀ж😀é"
    data = np.frombuffer(text.encode(), np.uint8)
    kind, offs = weak_quality.points(np.concatenate([data, data[:3]]), np.array([0, 0, len(data), len(data) + 3]))
    q = weak_quality
    want = [q.LETTER, q.CAPITAL, q.DIGIT, q.BLANK, q.LINE, q.END, q.END, q.SHOUT, q.POINT, q.POINT, q.SOLID, q.SOLID, q.SOLID, q.SOLID, q.SOLID, q.LETTER, q.OTHER, q.LETTER]
    assert kind.tolist() == want + want[:2] and offs.tolist() == [0, 0, len(text), len(text) + 2]
    assert q.points(np.zeros(0, np.uint8), np.zeros(3, np.int64))[1].tolist() == [0, 0, 0]


def test_lone_signs_by_definition():
    texts = [None, "", " | a", "a | b | ; c", "|", "x\n$$ 5 -", "。 好 。", "end |"]
    data, offs = batches.spans(pa.array(texts, pa.string()))
    kind, doc, n = weak_quality._counts(data, offs)
    want = []
    for t in texts:
        found = (t or "").split()
        want.append(sum(not any(c.isalnum() for c in w) for w in found) / max(1, len(found)))
    assert np.allclose(weak_quality._lone(kind, doc, len(texts)), want)


def test_plain_texts_of_other_scripts_stay(spark):
    plain = {
        "chinese": ["我们昨天去了城外的河边", "天气很好，孩子们在水里玩", "老人坐在树下说话", "没有人着急回家", "晚上大家一起吃饭，讲过去的故事"],
        "thai": ["เมื่อวานเราไปที่แม่น้ำนอกเมือง อากาศดีมาก", "เด็กๆเล่นน้ำอย่างมีความสุข", "คนแก่นั่งคุยกันใต้ต้นไม้", "ไม่มีใครรีบกลับบ้าน"],
        "greek": ["Χθες πήγαμε στο ποτάμι έξω από την πόλη", "Ο καιρός ήταν πολύ καλός", "Κανείς δεν βιαζόταν να γυρίσει σπίτι"],
        "arabic": ["ذهبنا أمس إلى النهر خارج المدينة", "كان الطقس جميلا جدا ولعب الأطفال في الماء", "جلس الشيوخ تحت الأشجار يتحدثون"],
    }
    ends, rng = {"chinese": "。", "thai": " "}, np.random.default_rng(3)
    rows, names = [(r["doc_id"], r["text"]) for r in table("documents")], {}
    for name, parts in plain.items():
        for _ in range(20):
            names[10**6 + len(names)] = name
            rows.append((10**6 + len(names) - 1, ends.get(name, ". ").join([*rng.choice(parts, rng.integers(3, 12)), ""])))
    got = {r.doc_id: r.kept for r in weak_quality.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {names[i] for i in names if not got[i]} == set()


@pytest.mark.parametrize("parts", [3, 7])
def test_scores_by_definition(spark, parts):
    """Scores under several partitionings against features counted one by one and the scorer's weights."""
    rows = [(r["doc_id"], r["text"][:2000]) for r in table("documents")] + [(9000, None), (9001, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    w, b, mean, middle = weak_quality.train(docs)
    got = {r.doc_id: r.quality_score for r in weak_quality.score(docs, (w, b, mean, middle)).collect()}
    base = {r.doc_id: r.quality_score for r in weak_quality.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert all(abs(got[i] - base[i]) < 1e-4 for i in got)
    for i, t in rows[:40] + rows[-2:]:
        kinds = [int(weak_quality._table()[min(ord(c), 0x20000)]) for c in t or ""]
        found = [w_.encode() for w_ in re.findall("[^\x20\x09-\x0d]+", t or "")]
        if not found:
            assert got[i] == 0
            continue
        h = [int(words.hashes(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0][0]) for x in found]
        lists = [[(((a * 10 + b_) * 10 + c) * 2654435761 >> 7) % 1023 for a, b_, c in zip(kinds, kinds[1:], kinds[2:])], [x % 1024 for x in h]]
        lists.append([int(words.mix(np.array([(x * 3 + y) % (1 << 64)], np.uint64))[0]) % 1024 for x, y in zip(h, h[1:])])
        total = b
        for k, own in enumerate(lists):
            share = np.bincount(own, minlength=1024) / max(1, len(own)) if own else np.zeros(1024)
            if k == 0:
                share[-1] = sum(x == y for x, y in zip(h, h[1:])) / len(h)
            own_weight = len(own) / (len(own) + weak_quality.PRIOR[k])
            part = slice(1024 * k, 1024 * k + 1024)
            total += np.sqrt(share * own_weight + mean[part] * (1 - own_weight)) @ w[part]
        told = len(lists[0]) / (len(lists[0]) + weak_quality.SHORT)
        assert abs(got[i] - told / (1 + np.exp(-total)) - (1 - told) * middle) < 1e-3


def test_em_finds_accuracies():
    rng = np.random.default_rng(2)
    truth_ = rng.random(20_000) < 0.2
    votes = np.stack([np.where(rng.random(20_000) < a, truth_, ~truth_) + 1 for a in (0.95, 0.9, 0.85, 0.8)], 1)
    codes, counts = np.unique(weak_quality.code(votes), return_counts=True)
    p = dict(zip(codes.tolist(), weak_quality.posterior(codes[:, None] // 3 ** np.arange(4) % 3, counts.astype(float))))
    assert np.mean([(p[c] > 0.5) == t for c, t in zip(weak_quality.code(votes).tolist(), truth_)]) > 0.95


def test_word_hashes():
    texts = ["Ab c", "", "  x\ty\x0b ", "ab", "AB é  " + "z" * 50, "q" * 17 + " " + "q" * 16, "\x1c a b"]
    import pyarrow as pa

    h, n = words.hashes(*batches.spans(pa.array(texts)))
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    want = [w for t in texts for w in re.split("[\x20\x09-\x0d]+", t.translate(low)) if w]
    assert len(want) == len(h) and len({*zip(want, h.tolist())}) == len({*want}) == len({*h.tolist()})


def test_e8():
    assert len(e8_neardup.roots()) == 240
    x = np.random.default_rng(3).standard_normal((500, 8)) * 2
    v = e8_neardup.decode(x)
    assert (((2 * v).astype(int) % 2).min(1) == ((2 * v).astype(int) % 2).max(1)).all() and (v.sum(1) % 2 == 0).all()
    near = ((x[:, None] - (v[:, None] + e8_neardup.roots()[None])) ** 2).sum(2).min(1)
    assert (((x - v) ** 2).sum(1) <= near + 1e-9).all()


@pytest.mark.parametrize("dim", [4, 8, 16, 64, 256, 1024])
def test_cells_meet_at_every_dimension(dim):
    rng, c = np.random.default_rng(dim), 0.93
    u, w = rng.standard_normal((2, 2000, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (w * u).sum(1, keepdims=True) * u
    a, b = e8_neardup.cells(u), e8_neardup.cells(c * u + np.sqrt(1 - c * c) * w / np.linalg.norm(w, axis=1, keepdims=True))
    meet = lambda a, b: np.mean(((a[:, :, :1] == b) | (a == b[:, :, :1])).any((1, 2)))
    assert meet(a, b) >= 0.997 and meet(a, np.roll(b, 1, 0)) < (0.5 if dim == 4 else 0.05 if dim < 64 else 0.005)


@pytest.mark.parametrize("setting", [s for _, s in e8_neardup.SETTINGS])
def test_every_setting_meets(setting):
    rng, c = np.random.default_rng(5), 0.93
    u, w = rng.standard_normal((2, 2000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (w * u).sum(1, keepdims=True) * u
    v = c * u + np.sqrt(1 - c * c) * w / np.linalg.norm(w, axis=1, keepdims=True)
    a, b = e8_neardup.cells(u, setting), e8_neardup.cells(v, setting)
    meet = ((a[:, :, :1] == b) | (a == b[:, :, :1])).any((1, 2))
    assert meet.mean() >= 0.996 and len({len(set(r.tolist())) for r in a[0]}) == 1 == len(set(a[0, 0].tolist())) // setting.asked
    assert (np.bitwise_count(e8_neardup.sketches(u) ^ e8_neardup.sketches(v)) <= e8_neardup.APART).all()


def test_few_unlike_vectors_meet():
    """100,000 vectors of one label with pairs planted at 0.93 to 0.94: fewer than 50 compared pairs a vector, and 0.99 of the planted ones among them."""
    rng, n, dim = np.random.default_rng(7), 100_000, 32
    u = rng.standard_normal((n, dim)).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = rng.uniform(0.93, 0.94, 2000)[:, None]
    w = rng.standard_normal((2000, dim))
    w -= (w * u[:2000]).sum(1, keepdims=True) * u[:2000]
    u[2000:4000] = c * u[:2000] + np.sqrt(1 - c * c) * w / np.linalg.norm(w, axis=1, keepdims=True)
    setting, pairs, planted = e8_neardup.setting_of(n), 0, np.zeros(2000, bool)
    keys = np.concatenate([e8_neardup.cells(u[k : k + 4096], setting) for k in range(0, n, 4096)])
    own = np.tile(np.arange(setting.asked) == 0, n)
    ids, sketch = np.repeat(np.arange(n), setting.asked), e8_neardup.sketches(u)
    for t in range(setting.tables):
        key = keys[:, t].reshape(-1)
        order = np.argsort(key, kind="stable")
        size = np.diff(np.flatnonzero(np.diff(key[order], prepend=key[order][0] - 1)), append=len(key))
        owns = np.add.reduceat(own[order].astype(np.int64), np.cumsum(size) - size)
        pairs += int((owns * (owns - 1) // 2 + owns * (size - owns)).sum())
        kept = set(ids[order][e8_neardup.near(key[order], own[order], ids[order], sketch[ids[order]])].tolist())
        a, b = keys[:2000, t], keys[2000:4000, t]
        planted |= ((a[:, :1] == b) | (a == b[:, :1])).any(1) & np.array([k in kept and k + 2000 in kept for k in range(2000)])
    print(pairs / n, planted.mean())
    assert planted.mean() >= 0.99 and pairs < 50 * n


def test_sketches_screen_by_definition():
    rng = np.random.default_rng(2)
    key, own, ids, sketch = np.sort(rng.integers(-40, 40, 300)), rng.random(300) < 0.3, rng.integers(0, 100, 300), rng.integers(0, 1 << 62, 300).astype(np.uint64)
    wanted = [i for i in range(300) if any(key[i] == key[j] and ids[i] != ids[j] and (own[i] or own[j]) and int(sketch[i] ^ sketch[j]).bit_count() <= e8_neardup.APART for j in range(300))]
    assert e8_neardup.near(key, own, ids, sketch).tolist() == wanted and len(wanted) > 20


def test_neardup_at_any_size(spark, monkeypatch):
    """Neither the number of rows of a label nor that of a cell decides what is compared: the setting stays, and a hot cell asks for near sketches as any other."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal(16)
    rows = [(k, [float(x) for x in base + 0.02 * rng.standard_normal(16)], 1) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    used, celled = [], e8_neardup.celled
    monkeypatch.setattr(e8_neardup, "celled", lambda reps, kind, setting: used.append(setting) or celled(reps, kind, setting))
    monkeypatch.setattr(e8_neardup, "SETTINGS", [(1, e8_neardup.SETTINGS[0][1]), (None, e8_neardup.SETTINGS[2][1])])
    wanted = [(k, 39, 0) for k in range(40)]
    found = lambda: sorted((r.vec_id, r.n_links, r.component_id) for r in e8_neardup.groups(df).collect())
    assert found() == wanted
    monkeypatch.setattr(e8_neardup, "CHUNK", 8)
    assert found() == wanted and set(used) == {e8_neardup.Setting(12, 2, 0.62, 12)}
    monkeypatch.setattr(e8_neardup, "APART", -1)
    assert found() == [(k, 0, k) for k in range(40)]


def test_neardup(spark):
    rng = np.random.default_rng(9)
    rows, k = [], 0
    for _ in range(40):
        base = rng.standard_normal(32)
        for _ in range(6):
            rows.append((k, [float(x) for x in np.float32(base + rng.standard_normal(32) * 0.15 * rng.random())], int(k % 7 == 0)))
            k += 1
    one = rows[0][1]
    rows += [(500, one, rows[0][2]), (501, one, None), (502, None, 0), (503, [0.0] * 32, 0), (504, [float("nan")] * 32, 0), (505, [None] * 32, 0), (506, one[:5], 0), (None, one, rows[0][2]), (507, [], 0), (508, [float("inf")] * 32, 0), (509, [x * 2 for x in one], rows[0][2]), (0, [-x for x in one], rows[0][2]), (510, one, -1), (511, one, -2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id if r.vec_id is not None else 999, r.n_links, r.component_id if r.component_id is not None else 999) for r in e8_neardup.groups(df).collect())
    ok = [v is not None and len(v) > 0 and all(x is not None for x in v) and np.isfinite(v).all() and np.any(v) and lab is not None for _, v, lab in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    key = lambda a: 999 if rows[a][0] is None else rows[a][0]
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.float64(np.float32(rows[a][1])), np.float64(np.float32(rows[b][1]))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    n[a] += 1
                    n[b] += 1
                    x, y = find(a), find(b)
                    if x != y:
                        root[x if key(x) > key(y) else y] = y if key(x) > key(y) else x
    want = sorted((key(a), n[a], key(find(a))) for a in range(len(rows)))
    links = sum(x[1] for x in want)
    assert sum(x[1] for x in got) >= 0.995 * links and all(g[1] <= w[1] for g, w in zip(got, want))
    assert e8_neardup.groups(df.limit(0)).count() == 0


def test_hot_cell_is_dealt_out(spark, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(k, [float(x) for x in np.float32(np.eye(16)[0] + rng.standard_normal(16) * 0.01)], 1) for k in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(e8_neardup, "CHUNK", 40)
    assert {(r.n_links, r.component_id) for r in e8_neardup.groups(df).collect()} == {(149, 0)}


def test_neardup_repeats_and_clashes(spark):
    """Repeated rows count each other, columns of the operator's own names are ignored, and doubles keep their precision."""
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0, "x", 1, 5.0), (1, v, 0, "x", 1, 5.0), (2, [x * 1e-200 for x in v], 0, "y", 2, 6.0), (3, [3.0, -2.0, 1.0], 0, "y", 2, 6.0), (4, [x * 1e200 for x in v], 0, "y", 2, 6.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, content string, id long, n double")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in e8_neardup.groups(df).collect())
    assert got == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 3, 1, False)]


# ---- centroid clustering ----


def lloyd(rows, k, rounds, dim):
    """The rounds by definition, in Python integers."""
    from math import floor, isfinite

    vs = [(i, [floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and isfinite(x) for x in v)]
    order = sorted(vs, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in vs]
        for c in range(len(cs)):
            own = [v for (_, v), a in zip(vs, at) if a == c]
            if own:
                cs[c] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, near(v)) for i, v in vs]
    inertia = [sum(d for _, (d, c) in found if c == n) for n in range(len(cs))]
    return sorted((repr(i), c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, (d, c) in found)


@pytest.mark.parametrize("spread", [0.0, 0.3, 3.0])
def test_sort_means(spark, spread):
    """Ties and repeats (small integers), nulls, other lengths, non-finite components, clashing names, and an empty table."""
    rng = np.random.default_rng(int(spread * 10))
    made = np.round(rng.normal(0, 1, (9, 4))[rng.integers(0, 9, 300)] + rng.normal(0, spread, (300, 4)) if spread else rng.integers(0, 2, (300, 4)), 2)
    rows = [(i % 250, v) for i, v in enumerate(np.float32(made).tolist())]
    rows += [(None, rows[3][1]), (None, [9.0, 9.0, 9.0, 9.0]), (900, None), (901, []), (902, [1.0, None, 0.0, 0.0]), (903, [1.0, float("nan"), 0.0, 0.0]), (904, [float("-inf"), 0.0, 0.0, 0.0]), (905, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 7, 1, [1], 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, part int, sums array<int>, n int")
    got = sort_means.clusters(df, dim=4, rounds=4)
    key = lambda r: (repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
    assert sorted(map(key, got.collect())) == lloyd(rows, 8, 4, 4)
    few = df.limit(3)
    assert sorted(map(key, sort_means.clusters(few, dim=4).collect())) == lloyd([(r.vec_id, r.embedding) for r in few.collect()], 8, 10, 4)
    assert sort_means.clusters(df.limit(0), dim=4).columns == got.columns and not sort_means.clusters(df.limit(0), dim=4).count()


def test_sort_means_refuses_to_wrap(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        sort_means.clusters(df).collect()


def test_sort_means_scan_stops_early():
    """All nearest centroids by definition, though most of well separated ones are never tried."""
    rng = np.random.default_rng(1)
    centroids = rng.integers(-5000, 5000, (40, 16))
    at = rng.integers(0, 40, 5000)
    v = centroids[at] + rng.integers(-300, 300, (5000, 16))
    d = ((v[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    for previous in (at, rng.integers(0, 40, 5000)):
        best, least, taken = sort_means.scan(v, previous, centroids)
        assert (best == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
        if previous is at:
            assert taken < 2 * len(v)


# ---- cross-tokenizer alignment ----


def aligned(rows):
    """Tokens, groups and links by definition, from whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    byte = trie_bpe.alphabet()
    out, counts = [], {}
    for doc_id, text in rows:
        one, groups, links = " " + (text or ""), [], []
        if text:
            ta = [(i, len(bytes(byte[c] for c in a.id_to_token(i)))) for i in a.encode(one, add_special_tokens=False).ids]
            spelt = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
            if b"".join(x for _, x in spelt) == one.encode():
                x, y = [], []
                for out_list, toks in ((x, ta), (y, [(i, len(s)) for i, s in spelt])):
                    end = 0
                    for i, n in toks:
                        out_list.append((end, end + n, i))
                        end += n
                cuts = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
                for hi in cuts:
                    inside = []
                    for side in (x, y):
                        n = next((k for k, t in enumerate(side) if t[1] > hi), len(side))
                        inside.append(side[:n])
                        del side[:n]
                    groups.append("|".join(",".join(str(i) for _, _, i in side) for side in inside))
                    links += [(i, j) for s, e, i in inside[0] for t, f, j in inside[1] if s < f and t < e]
        for p in links:
            counts[p] = counts.get(p, 0) + 1
        out.append((doc_id, groups, links, (sum(g.partition("|")[0].count(",") + 1 for g in groups), sum(g.partition("|")[2].count(",") + 1 for g in groups))))
    most = {}
    for (i, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return sorted(
        (repr(d), *n, len(g), len(l), sum(counts[p] == most[p[1]] for p in l), sum(counts[p] for p in l), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, g, l, n in out
    )


def aligned_key(r):
    return (repr(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def odd_texts(seed, n):
    rng = random.Random(seed)
    alphabet = ["a", "b", "the", " ", "  ", "   ", "\n", "\t", "\r\n", "1234", "'s", ".", ";", "é", "é", "€", "日本", "▁", "　", "\x00", "😀", "<|endoftext|>", "<s>", "</s>", "<0x41>", "<unk>", "ﬁ", "İ", "tokenization", "über"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("heavy", [token_align.HEAVY, 40, 1])
def test_token_align(spark, awkward, heavy):
    """Awkward rows, whole texts of the tables and random ones, by definition; with a small ``heavy`` most pairs take the join."""
    texts = [(i, t) for i, t in enumerate(odd_texts(5, 400))] + [(r["doc_id"], r["text"]) for r in table("documents")[:40]] + AWKWARD + [(77, " ".join(["word"] * 3000) + " end ")]
    df = spark.createDataFrame([(i, t, "x", 1, [3]) for i, t in texts], "doc_id long, text string, key string, uid int, pairs array<int>").repartition(3)
    assert sorted(map(aligned_key, token_align.alignments(df, queries.BYTE_BPE, queries.PIECES, heavy).collect())) == aligned(texts)


def test_token_align_empty(spark, empty):
    assert token_align.alignments(empty, queries.BYTE_BPE, queries.PIECES).count() == 0


def test_token_align_in_windows(monkeypatch):
    """Small windows and slices give what large ones give."""
    a, b = token_align.encoders(queries.BYTE_BPE, queries.PIECES)
    texts = odd_texts(9, 200) + ["x" * 5000, "word " * 3000]
    data = batches.spans(pa.array(texts))
    whole = token_align.align(*data, a, b)
    monkeypatch.setattr(token_align, "WINDOW", 7)
    monkeypatch.setattr(token_align, "SLICE", 5)
    parts = token_align.align(*data, a, b)
    assert all(np.array_equal(whole[k], parts[k]) for k in whole)


def test_pieces_equal_library():
    """Chunks remembered or new, cut at spaces, give the library's ids of whole texts."""
    e = token_align.Pieces(queries.PIECES)
    assert not e.whole
    texts = [t.replace("▁", "_") for t in odd_texts(11, 1500) if t] + [r["text"] for r in table("documents")[:80]] + [" ", "  ", "a ", " a", "a  "]
    for _ in range(2):
        ids, counts = e.spans(*batches.spans(pa.array([" " + t for t in texts])))
        wanted = e.sp.encode(texts)
        assert counts.tolist() == [len(x) for x in wanted] and ids.tolist() == [i for x in wanted for i in x]
    e.whole = True
    again, _ = e.spans(*batches.spans(pa.array([" " + t for t in texts])))
    assert again.tolist() == ids.tolist()


# ---- shards ----


def together(rows):
    """Shard sizes, and the share of linked pairs that one shard holds."""
    from collections import Counter

    pairs = lambda c: sum(n * (n - 1) // 2 for n in c.values())
    inside, every = Counter((r.text_crc32, r.size, r.shard) for r in rows), Counter((r.text_crc32, r.size) for r in rows)
    return Counter(r.shard for r in rows), pairs(inside) / max(1, pairs(every))


def laid_out(rows, docs):
    """The law ``rows`` and the plain columns, by definition."""
    per, _ = together(rows)
    counts = [per.get(s, 0) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(docs)
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    plain = lambda i, t: (repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None)
    assert sorted((repr(r.doc_id), r.size, r.text_crc32, r.law, r.grown_shard) for r in rows) == sorted(plain(i, t) for i, t in docs)


def test_label_shards(spark, awkward, empty):
    laid_out(sharding.shards(awkward).collect(), AWKWARD)
    assert sharding.shards(empty).count() == 0
    docs = table("documents")
    rows = sharding.shards(spark.createDataFrame([(r["doc_id"], r["text"], 1, "x") for r in docs], "doc_id long, text string, shard int, g string").repartition(3)).collect()
    laid_out(rows, [(r["doc_id"], r["text"]) for r in docs])
    assert together(rows)[1] == 1.0


@pytest.mark.parametrize("kind, least", [("pairs", 0.95), ("hot", 0.13), ("fours", 0.9)])
def test_label_shards_keep_copies_together(spark, kind, least):
    """Tables without an unlinked row, and one of whose rows a third are copies of one text (5.3 shards' worth)."""
    text = {"pairs": lambda i: f"t{i // 2}", "fours": lambda i: f"t{i // 4}", "hot": lambda i: "hot" if i % 3 == 0 else f"t{i // 7}"}[kind]
    docs = [(None if i % 3 == 0 else i, text(i)) for i in range(12_000)]
    rows = sharding.shards(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    laid_out(rows, docs)
    assert together(rows)[1] >= least
    if kind == "hot":
        assert together([r for r in rows if r.size != 4])[1] >= 0.7


def test_label_shards_are_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = sharding.shards(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))

"""The operators against brute force, round trips and held-out accuracy, and their defined cases on small tables."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from trackframe.llm import (common, exact_dedup, fuse_filter, gru, html_text, langid, lm_scoring, mixing, order_minhash, pieces, pii, queries, sharding, simhash)

LONG = "word " * 30_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names."""
    common.ship(spark)
    rows = [(1, "the cat sat on the mat", "en", "a"), (1, "the cat sat on the mat", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "the cat  sat on\tthe mat", "fr", "b"),
            (4, LONG, "en", "b"), (5, "12 34 .", None, "b"), (6, "THE cat sat on the mat", "en", None), (7, "le chat est sur la table", "fr", "b"), (None, None, "fr", "a")]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, kept int, fingerprint string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    common.ship(spark)
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def test_fuse_filter_never_misses():
    rng = np.random.default_rng(1)
    other = rng.integers(0, 2 ** 63, 50_000).astype(np.uint64)
    for n in (0, 1, 2, 7, 500, 20_000):
        keys = rng.integers(0, 2 ** 63, n).astype(np.uint64)
        f = fuse_filter.build(np.r_[keys, keys])
        assert fuse_filter.contains(keys, *f).all()
        assert fuse_filter.contains(other, *f).mean() < 1e-3


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return groups


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_dedup_is_brute_force_even_when_digests_collide(odd, docs, digest):
    for df in (odd, docs):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = exact_dedup.dedup(df, batches=3, digest=digest).collect()
        want = [(i, min((x for x in g if x is not None), default=None), len(g)) for g in brute_groups(rows).values() for i in g]
        key = lambda x: tuple((v is None, v) for v in x)
        assert sorted(((r["id"], r["keep_id"], r["group_size"]) for r in got), key=key) == sorted(want, key=key)
        assert sum(r["kept"] for r in got) == len(brute_groups(rows))


def test_deduplicated_keeps_one_whole_row_a_group(odd, docs):
    for df in (odd, docs):
        out = exact_dedup.deduplicated(df)
        assert out.columns == df.columns
        assert out.count() == len(brute_groups([(r["doc_id"], r["text"]) for r in df.collect()]))


def components(fps, radius):
    fps = sorted(fps)
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(fps, 2):
            if bin(a ^ b).count("1") <= radius and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def slow_fingerprint(text, width):
    import xxhash
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    parts = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_is_brute_force(odd, docs):
    for df in (odd, docs):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        fp = [slow_fingerprint(t, 4) for _, t in rows]
        label = components(set(fp), 4)
        least = {}
        for (i, _), f in zip(rows, fp):
            if i is not None:
                least[label[f]] = min(least.get(label[f], i), i)
        got = simhash.near_dedup(df).select("id", "fp", "component_id", "kept").collect()
        key = lambda x: tuple((v is None, v) for v in x)
        assert sorted(((r["id"], r["fp"] % 2 ** 64, r["component_id"]) for r in got), key=key) == sorted(((i, f, least.get(label[f])) for (i, _), f in zip(rows, fp)), key=key)
        assert sum(r["kept"] for r in got) == len(set(label.values())) == simhash.deduplicated(df).count()


def test_simhash_links_of_crowded_buckets(spark):
    rng = np.random.default_rng(3)
    near = [int(x) for x in rng.integers(0, 2 ** 62, 12)]
    fps = sorted({f ^ sum(1 << int(b) for b in rng.integers(0, 64, k)) for f in near for k in range(8)})
    want = components(fps, 4)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    for bucket, refine in ((2048, 2), (4, 2), (4, 0)):  # plain, dealt anew twice, in parts
        got = {r["node"] % 2 ** 64: r["label"] % 2 ** 64 for r in simhash.components(simhash.links(df, len(fps), 4, bucket, refine)).collect()}
        mine = {f: got.get(f, f) for f in fps}
        assert all((mine[a] == mine[b]) == (want[a] == want[b]) for a, b in itertools.combinations(fps, 2))


def test_simhash_radius_zero_links_equal_fingerprints_only(odd):
    got = simhash.near_dedup(odd, radius=0).select("id", "fp", "component_id").collect()
    least = {}
    for r in got:
        if r["id"] is not None:
            least[r["fp"]] = min(least.get(r["fp"], r["id"]), r["id"])
    assert len(got) == odd.count() and all(r["component_id"] == least.get(r["fp"]) for r in got)


def test_bit_planes_and_counters():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 2 ** 64, 200, dtype=np.uint64)
    fp[100:] = fp[:100] ^ (np.uint64(7) << rng.integers(0, 60, 100).astype(np.uint64))
    for radius in (1, 2, 3, 4, 7):
        a, b = simhash.bucket_links(fp, np.zeros(200, int), radius)
        assert (np.bitwise_count(a ^ b) < 64).all()
        i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius)
        at = {f: k for k, f in enumerate(fp.tolist())}
        assert (simhash.forest(200, i, j) == simhash.forest(200, np.array([at[x] for x in a.tolist()], int), np.array([at[x] for x in b.tolist()], int))).all()


def test_pfair_lag_stays_below_one_block():
    for weights in ({"a": 1.0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {f"s{i}": 1.0 / (i + 1) for i in range(20)}):
        a = mixing.parts(weights, 100)
        got = mixing.one_period(a)
        assert sum(a.values()) == len(got) == 100
        for s, w in a.items():
            for t in range(101):
                assert abs(got[:t].count(s) - t * w / 100) < 1


def test_mix_keeps_to_the_given_weights():
    few = {f"s{i}": (85_470 if i == 0 else 8_997) ** 0.5 for i in range(20)}  # one holds a third of the rows
    many = {f"s{i}": 0.5 if i == 0 else 0.5 / 499 for i in range(500)}
    for weights, blocks in ((few, {s: 5342 if s == "s0" else 563 for s in few}), (many, {s: 20_000 if s == "s0" else 41 for s in many}), ({"a": 0.7, "b": 0.2, "c": 0.1}, dict.fromkeys("abc", 3000))):
        got = mixing.schedule(weights, blocks)
        assert sorted(t for slots, _ in got.values() for t in slots.tolist()) == list(range(sum(blocks.values())))
        last = max(int(phase[-1]) for _, phase in got.values())
        ends = [1 + max(int(slots[phase == p][-1]) for slots, phase in got.values() if (phase == p).any()) for p in range(last + 1)]
        for p in range(last + 1):
            begin = ends[p - 1] if p else 0
            total = sum(weights[s] for s, (_, phase) in got.items() if phase[-1] >= p)
            for s, (slots, phase) in got.items():
                if phase[-1] < p:
                    continue
                t, w = slots[phase == p] - begin, weights[s] / total
                k = np.arange(len(t))
                assert (w * t - k < 1 + 1e-6).all() and (k + 1 - w * (t + 1) < 1 + 1e-6).all() and w * (ends[p] - begin) - len(t) < 1 + 1e-6


def test_mix_places_every_row_once(odd, none, docs):
    for df, w in ((odd, {"a": 1.0, "b": 2.0}), (docs, mixing.tempered(docs)), (none, {"a": 1.0})):
        out = mixing.mix(df, w, block_rows=4, period=50)
        rows = sorted(out.select("position", "slot", "mix_source").collect())
        assert [r["position"] for r in rows] == list(range(df.count()))
        assert [r["slot"] for r in rows] == sorted(r["slot"] for r in rows)
        assert len({(r["slot"], r["mix_source"]) for r in rows}) == len({r["slot"] for r in rows})


def test_mixed_files_keep_the_order(docs, spark):
    want = [r["doc_id"] for r in mixing.mix(docs, mixing.tempered(docs)).orderBy("position").collect()]
    back = common.written(mixing.mixed(docs), "mixed").withColumn("f", F.input_file_name()).withColumn("i", F.monotonically_increasing_id())
    assert [r["doc_id"] for r in sorted(back.collect(), key=lambda r: (r["f"].rpartition("/")[2], r["i"]))] == want


def test_shards(odd, none, docs):
    for df in (odd, docs, none):
        out = sharding.shard(df, shards=4).toPandas()
        rows = df.select("doc_id", "text").collect()
        assert sorted(out["text_crc32"]) == sorted(zlib.crc32((r["text"] or "").encode()) for r in rows)
        assert sorted(out["size"]) == sorted(len((r["text"] or "").encode()) + 1 for r in rows)
        for _, part in out.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))
    full = sharding.shard(docs, shards=4).toPandas()
    size = full.groupby("shard")["size"].sum()
    assert size.max() < 1.1 * size.min()
    assert (full.groupby("text_crc32")["shard"].nunique() == 1).all()


def test_hot_group_is_split(spark):
    df = spark.createDataFrame([(i, "same text" if i < 600 else f"text {i}") for i in range(900)], "doc_id long, text string")
    size = sharding.shard(df, shards=4).toPandas().groupby("shard")["size"].sum()
    assert len(size) == 4 and size.max() < 1.2 * size.min()


def test_language_id(odd, none, docs):
    model = langid.learned(docs)
    got = langid.predict(docs, model).toPandas().merge(docs.select("doc_id", "lang").toPandas(), left_on="id", right_on="doc_id")
    held = got[[zlib.crc32(str(i).encode()) % 4 == 2 for i in got["id"]]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95
    assert got["rejected"].mean() < 0.01
    rows = {(r["id"], r["lang_pred"], r["rejected"]) for r in langid.predict(odd, model).collect()}
    assert {(2, "und", True), (3, "und", True), (5, "und", True)} <= rows
    assert langid.predict(none, model).count() == 0
    assert langid.learned(none) is None and {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}
    strange = docs.sparkSession.createDataFrame([(1, "xqj zkvb wrtpq qqqzx vbxnk kjhgf zdswp pzxqk mnbvk lkjhz " * 4)], "doc_id long, text string")
    assert langid.predict(strange, model).first()["rejected"]


def test_every_language_is_learned(spark, monkeypatch):
    rows = [(k, "ab" * 3 + f" {k} " + "xyz"[k % 3] * 5, f"l{k}", k) for k in range(600)] + [(1000 + k, "lorem ipsum " * 2000, "long", k) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, h long")
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 20_000)
    langs = langid.languages(df)
    fit, own = (langid.sampled(df, langs, f, 20_000, 1).toPandas() for f in (True, False))
    assert set(fit["lang"]) == {f"l{k}" for k in range(600)} | {"long"} and fit["text"].str.len().max() <= langid.PIECE
    assert fit["text"].str.len().sum() < 20_000 / 0.75 + 603 * 20 + langid.PIECE
    whole = [langid.sampled(df, langs, f, 10 ** 9, 1).toPandas()["text"].str.len().sum() for f in (True, False)]
    assert sum(whole) == sum(len(r[1]) for r in rows) and len(own) <= 603 * 6


def test_kneser_ney_sums_to_one(docs):
    model = langid.learned(docs)
    alphabet = np.array(sorted({c for r in docs.limit(50).collect() for c in langid.symbols(r["text"]).tolist()} | set(range(97, 123))), np.uint32)
    for start in ("    the ", "  onand", "    xqzt"):
        head = np.frombuffer(start.encode("utf-32-le"), np.uint32)
        rows = [langid.grams(np.append(head, c)) for c in alphabet]
        logs = model.logs([np.array([r[k][-1] for r in rows]) for k in range(langid.ORDER)], [np.array([r[k][-2] for r in rows]) for k in range(langid.ORDER)])
        assert (np.exp(logs.astype(float)).sum(axis=0) < 1.001).all()


def test_order_minhash(odd, none, docs):
    for df in (odd, docs):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()))
        got = {r["id"]: r for r in order_minhash.compare_edits(df.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
        for k, (i, text) in enumerate(rows):
            after = rows[(k + 1) % len(rows)][1]
            new = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
            assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[i]["n_chars"] == len(text)
            a, b = order_minhash.fingerprint(text), order_minhash.fingerprint(after)
            assert got[i]["fingerprint"] == order_minhash.shown(a) and got[i]["near_next"] == order_minhash.likeness(a, b)
            assert got[i]["near_edited"] == order_minhash.likeness(a, order_minhash.fingerprint(new))
    assert order_minhash.compare_edits(odd).count() == odd.count()
    assert order_minhash.compare_edits(none).count() == 0
    base = " ".join(f"w{i * 7919 % 1000}" for i in range(200))
    swapped = base[len(base) // 2:] + base[:len(base) // 2]
    assert order_minhash.likeness(order_minhash.fingerprint(base), order_minhash.fingerprint(swapped)) < 0.95  # same k-mers, other order
    assert order_minhash.likeness(order_minhash.fingerprint(base), order_minhash.fingerprint(base + " x")) > 0.9


def test_occurrence_numbers():
    h = np.array([5 << 40, 7 << 40, 5 << 40, 5 << 40, 7 << 40], np.uint64)
    assert order_minhash.occurrence(h).tolist() == [0, 0, 1, 2, 1]


def test_pseudonyms():
    text = "Call +1 (212) 555-0123, card 4111 1111 1111 1111 (4111111111111111), born 29.02.1984, ip 10.0.0.255, DE89370400440532013000, 123-45-6789, a.b@c.example.com. No: 4111111111111112, 31.02.1984, 300.1.1.1"
    clean, finds = pii.pseudonymise(text)
    assert [f["kind"] for f in finds] == ["phone", "card", "card", "date", "ip", "iban", "ssn", "email"]
    assert re.sub(r"\d", "", finds[1]["pseudonym"]) == "   " and finds[1]["pseudonym"].replace(" ", "") == finds[2]["pseudonym"]
    assert pii.pseudonymise(clean)[1] and pii.pseudonymise(clean, back=True)[0] == text
    assert clean.endswith("No: 4111111111111112, 31.02.1984, 300.1.1.1")
    assert pii.pseudonymise(text, b"other")[0] != clean
    for size in (2, 3, 10, 97, 1000):
        image = [pii.permute(x, size, b"k", "t") for x in range(size)]
        assert sorted(image) == list(range(size)) and [pii.permute(y, size, b"k", "t", back=True) for y in image] == list(range(size))


def test_dates_in_either_order_and_cards_among_other_digits():
    for text in ("25/12/2020", "12/25/2020", "5/3/2020", "25/3/2020", "1.2.2020", "31.1.1999", "2020-1-5", "2020/01/05", "12-25-2020", "05/3/2020"):
        clean, finds = pii.pseudonymise(f"on {text} or")
        assert [(f["kind"], f["start"], f["length"]) for f in finds] == [("date", 3, len(text))] and pii.pseudonymise(clean, back=True)[0] == f"on {text} or"
        assert re.sub(r"\d", "0", clean) == re.sub(r"\d", "0", f"on {text} or")
    for text in ("31/31/2020", "32/1/2020", "30/2/2020", "13.13.2020", "2020-13-1", "1/2/1899", "1/2-2020"):
        assert pii.pseudonymise(text) == (text, [])
    number = "4111 1111 1111 1111"
    alone = pii.pseudonymise(number)[0]
    for before, after in (("", " 12/25"), ("", " 123"), ("order 12 ", ""), ("123 456 ", ""), ("", " " + number), ("25-12-2020 ", " 7")):
        clean, finds = pii.pseudonymise(before + number + after)
        assert [f["pseudonym"] for f in finds if f["kind"] == "card"] == [alone] * (before + number + after).count(number)
        assert number not in clean and alone in clean
    for wide in (False, True):
        for form in ((wide, False, True), (True, wide, False)):
            assert len(set(pii.days(*form))) == len(pii.days(*form)) < pii.DAYS


def test_pseudonyms_leave_clean_rows(odd, none):
    got = {(r["doc_id"], r["text"], r["clean_text"]) for r in pii.pseudonyms(odd).collect()}
    assert all(t == c for _, t, c in got) and pii.pseudonyms(none).count() == 0


def test_html_main_text():
    page = ("<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>"
            "<div class='cookie-notice'>We use cookies, please accept all of them now.</div><article><h1>A&amp;B</h1><p>First  paragraph with <a href=x>a link</a> in\nit.<p>Second &eacute;t&eacute; one"
            "<br>goes on.</p><form><input><label>Mail</label></form><div id=comments><p>I liked this very much, thank you for the article.</p></div></article><aside>More things to read elsewhere.</aside><footer>&copy; 2020 us</footer>")
    assert html_text.extract(page) == "A&B\nFirst paragraph with a link in it.\nSecond été one goes on."
    assert html_text.extract(None) == html_text.extract("") == ""
    main = "<p>Main text of the article goes on for some words.</p><p>Short.</p>"
    text = "Main text of the article goes on for some words.\nShort."
    other = "Some other words that stand on the page and go on for a while."
    for page in (f"<main><article>{main}</article><section id=comments><article class=comment><div class=content><p>{other}</div></article></section></main>",
                 f"<article>{main}<aside><article><h2>More</h2><p>{other}</article></aside></article>",
                 f"<div class='layout with-sidebar'><div class=content>{main}</div><div class=sidebar><div class=content>{other}</div></div></div>",
                 f"<div class=content-sidebar-wrap><div class=content>{main}</div></div>",
                 f"<article class='post comments-open'>{main}<div style='display: none'><article><p>{other}</article></div></article>",
                 f"<form id=aspnetForm><div id=main>{main}</div></form>",
                 f"<article>{main}</article><div class=cookie-notice><p class=content>{other}</div>"):
        assert html_text.extract(f"<body class='single-post has-sidebar'>{page}</body>") == text, page


def test_minimum_cut_is_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 8))
        gain = rng.normal(size=n).tolist()
        pairs = [(i, j, float(rng.random())) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(keep):
            return sum(-g if k and g < 0 else g if not k and g > 0 else 0 for g, k in zip(gain, keep)) + sum(c for i, j, c in pairs if keep[i] != keep[j])
        assert cost(html_text.minimum_cut(gain, pairs)) == pytest.approx(min(cost(k) for k in itertools.product([True, False], repeat=n)))


@pytest.fixture(scope="module")
def lattice():
    return pieces.Pieces()


def segmentations(p, text):
    """Every segmentation of ``text`` (without U+2581) over the whole lattice."""
    whole = pieces.SPACE + text.replace(" ", pieces.SPACE)

    def rest(i):
        if i == len(whole):
            yield 0.0, ()
        for j in range(i + 1, len(whole) + 1):
            hit = p.node.get(whole[i:j])
            if hit is None and j == i + 1:
                raw = whole[i].encode()
                hit = (tuple(p.byte[b] for b in raw), p.byte_score * len(raw))
            if hit:
                for s, ids in rest(j):
                    yield hit[1] + s, (hit[0] if isinstance(hit[0], tuple) else (hit[0],)) + ids
    return sorted(rest(0), key=lambda x: -x[0])


def test_n_best_is_brute_force(lattice):
    for text in ("ab cd", "the.\nIt", "  x", "né ☃", "hello", "a b c d"):
        ids, score, best = lattice.encode(text, 5)
        want = segmentations(lattice, text)[:5]
        assert score == pytest.approx(want[0][0]) and [b["score"] for b in best] == pytest.approx([w[0] for w in want])


def test_runs_of_spaces_over_the_whole_vocabulary(lattice):
    import math
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    plain.sort(key=lambda i: (-sp.get_score(i), i))
    mass = math.log(sum(1 / (r + 1) for r in range(len(plain) + 1)))
    score = {sp.id_to_piece(i): (i, -math.log(r + 1) - mass) for r, i in enumerate(plain)}
    longest = max(len(x) for x in score)

    def merged(whole, n):
        """Forward n-best lists over every piece; characters without one by bytes."""
        best = [[(0.0, ())]]
        for j in range(1, len(whole) + 1):
            ways = []
            for i in range(max(0, j - longest), j):
                hit = score.get(whole[i:j])
                if hit is not None:
                    ways += [(s + hit[1], ids + (hit[0],)) for s, ids in best[i]]
                elif j == i + 1:
                    raw = whole[i].encode()
                    ways += [(s + (-math.log(len(plain) + 1) - mass) * len(raw), ids + tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in raw)) for s, ids in best[i]]
            best.append(sorted(ways, key=lambda x: (-x[0], x[1]))[:n])
        return best[-1]
    for text in ("a   b", "a b", "    x", "if x:\n        y = 1\n  z", "a" + " " * 40 + "b", "a  ", "   ", "a | b    | c", "☃  é   x"):
        ids, got, best = lattice.encode(text, 5)
        want = merged(pieces.SPACE + text.replace(" ", pieces.SPACE), 5)
        assert got == pytest.approx(want[0][0]) and [b["score"] for b in best] == pytest.approx([w[0] for w in want]), text
        assert lattice.decode(ids) == text
    assert len(lattice.encode("a    b")[0]) == len(lattice.encode("a b")[0]) + 1
    for text in ("a ▁  ▁b", "▁▁x", "  ▁", " " * 20_000 + "x"):
        assert lattice.decode(lattice.encode(text)[0]) == text


def test_round_trip(lattice, odd, none, docs):
    for text in ("", " ", "a▁b ▁", "tab\tand\r\nline", "☃ 漢字 \x00 🙂", "x" * 500):
        assert lattice.decode(lattice.encode(text)[0]) == text
    for df in (odd, docs):
        got = pieces.encode(df).collect()
        assert len(got) == df.count() and all(r["round_trip"] or r["text"] is None for r in got)
        assert all((r["ids"] is None) == (r["text"] is None) for r in got)
    assert pieces.encode(none).count() == 0


def test_gradient():
    rng = np.random.default_rng(0)
    w = {k: (v + 0.1 * rng.standard_normal(v.shape)).astype(float) for k, v in gru.fresh(rng.random((3, 4)) + 0.1, 1.0, 5).items()}
    ids, goal, h = rng.integers(0, 13, (6, 3)), rng.integers(0, 13, (6, 3)), rng.standard_normal((3, 5))
    args = (h, ids, goal, ids == 2)
    grad = gru.gradient(w, *args)[0]
    for k in w:
        at = (ids[0, 0], 1) if k == "x" else tuple(int(rng.integers(0, s)) for s in w[k].shape)
        old = w[k][at]
        loss = []
        for e in (1e-5, -1e-5):
            w[k][at] = old + e
            loss.append(gru.gradient(w, *args)[2])
        w[k][at] = old
        assert (loss[0] - loss[1]) / 2e-5 == pytest.approx(grad[k][at], abs=1e-5)


def test_state_is_carried_over_windows():
    rng = np.random.default_rng(4)
    w = gru.fresh(rng.random((3, 4)) + 0.1, 1.0, 5)
    texts = [rng.integers(0, 13, n) for n in (1, 200, 33, 32, 64)]
    got = gru.document_logs(w, texts, 0)
    for text, have in zip(texts, got):
        h, last, total = np.zeros((1, 5), np.float32), 0, 0.0
        for x in text:
            h, _ = gru.step(w, h, np.array([last]))
            total += float(gru.output(w, h, np.array([x]))[0])
            last = x
        assert have == pytest.approx(total, rel=1e-4)


def test_lm_scoring_shuffles_the_texts_once(docs):
    out = lm_scoring.score(docs, ~lm_scoring.held_out(F.col("doc_id")))
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_lm_scoring(odd, none, docs):
    from collections import Counter
    import math
    got = {r["id"]: r for r in lm_scoring.score(docs, ~lm_scoring.held_out(F.col("doc_id"))).collect()}
    rows = docs.collect()
    counts = Counter(t for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 10 for t in lm_scoring.tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    gain = []
    for r in rows:
        t = lm_scoring.tokens(r["text"])
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        have = got[r["doc_id"]]
        assert (have["n_tokens"], have["n_known"], have["train_tokens"]) == (len(t), sum(x in counts for x in t), n)
        assert have["base_score"] == pytest.approx(base) and np.isfinite(have["score"])
        if zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0:
            gain.append((have["score"] - have["base_score"]) / len(t))
    assert np.mean(gain) > 0
    small = lm_scoring.score(odd, F.lit(True)).collect()
    assert len(small) == odd.count() and all(np.isfinite(r["score"]) for r in small)
    assert lm_scoring.score(none, F.lit(True)).count() == 0
    nothing = lm_scoring.score(odd, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["score"] == r["base_score"] for r in nothing)


def test_the_language_model_learns_from_every_row(docs, monkeypatch):
    from collections import Counter
    counts = Counter(t for r in docs.collect() for t in lm_scoring.tokens(r["text"]))
    top = sorted(counts, key=lambda x: (-counts[x], x))[:lm_scoring.HEAD]
    n = sum(counts.values())
    monkeypatch.setattr(lm_scoring, "TRAIN_TOKENS", 100)
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", n // 60)  # some 20 shards a round, so averaged in a tree
    for df, m in ((docs, n), (docs.unionAll(docs.withColumn("doc_id", F.col("doc_id") + 10 ** 9)), 2 * n)):
        rows = df.select("text", F.xxhash64("doc_id", "text").alias("h"))
        w, seen = lm_scoring.fit(rows, {x: i for i, x in enumerate(top)}, np.array([counts[x] * m // n for x in top]), m)
        assert sum(seen) == m and all(np.isfinite(x).all() for x in w.values())


def test_empty_tables(none):
    assert exact_dedup.dedup(none).count() == simhash.near_dedup(none).count() == sharding.shard(none).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    at, kept = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        at = common.written(stage(spark, at, SF_SMALL), "stage")
        kept.append(at.count())
        if name != names[-1]:
            assert at.columns == docs.columns
    texts = {re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]) for r in docs.collect()}
    labels = components({slow_fingerprint(t, 4) for t in texts}, 4)
    assert kept[1] == kept[0] and kept[2] == len(texts) and kept[3] == kept[4] == kept[5] == len(set(labels.values()))
    assert sorted(r["doc_id"] for r in at.collect()) == sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF_SMALL).collect())


def test_pipeline_keeps_the_mix(spark, docs):
    import corpus_pipeline
    at = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        at = common.written(stage(spark, at, SF_SMALL), "stage")
    want = [(r["doc_id"], r["position"]) for r in mixing.mix(at, mixing.tempered(at)).orderBy("position").collect()]
    assert [(r["doc_id"], r["position"]) for r in corpus_pipeline.run(spark, SF_SMALL).collect()] == want
    scattered = corpus_pipeline.STAGES[4][1](spark, common.written(at.repartition(7, "text"), "scattered"), SF_SMALL)
    assert [(r["doc_id"], r["position"]) for r in scattered.collect()] == want


def test_every_query_has_its_columns(spark):
    assert {re.match(r"op(\d+)_", q)[1] for q in queries.QUERIES} == set(map(str, range(1, 14)))
    for name in ("op1_mixing", "op2_sharding", "op7_html_text"):
        assert queries.QUERIES[name](spark, SF_SMALL).count() > 0


def test_many_texts_are_split_as_one(monkeypatch):
    import pyarrow as pa
    texts = [None, "", " ", "a", " A\x0bb\x0c\x1cC\r\n", "Ä É x y", "b" * 50, "\t", "İ ſ K  z", "a\x85b a\x00b"] * 3
    monkeypatch.setattr(lm_scoring, "PIECE_BYTES", 20)
    head = {b"a": 0, lm_scoring.END: 1}
    size, words, codes = [], [], []
    for column in (pa.chunked_array([texts[:4], texts[4:4], texts[4:]], pa.string()), pa.array(texts[3:], pa.string())[2:]):
        for piece in lm_scoring.pieces(column):
            n, found = lm_scoring.split(piece)
            size += n.tolist()
            words += found.to_pylist()
            codes += lm_scoring.with_ends(n, lm_scoring.head_codes(found, head).fill_null(9).to_numpy(), 1).tolist()
    each = [lm_scoring.tokens(t) for t in texts + texts[5:]]
    assert size == [len(e) - 1 for e in each] and words == [x for e in each for x in e[:-1]]
    assert codes == [head.get(x, 9) for e in each for x in e]


def test_outputs_of_many_steps_are_worked_out_together(monkeypatch):
    rng = np.random.default_rng(5)
    w, calls, output = gru.fresh(rng.random((3, 4)) + 0.1, 1.0, 6), [], gru.output
    monkeypatch.setattr(gru, "output", lambda w, h, ids: calls.append(len(ids)) or output(w, h, ids))
    texts = [rng.integers(0, 13, n) for n in (20_000, 3, 700)]
    assert np.isfinite(gru.document_logs(w, texts, 0)).all()
    assert sum(calls) == 20_703 and len(calls) <= 4  # a window at a time made 625
    h, _ = gru.step(w, np.zeros((40, 6), np.float32), rng.integers(0, 13, 40))
    assert h.shape == (40, 6) and h.T.flags.c_contiguous


def test_training_follows_adam():
    rng = np.random.default_rng(6)
    w = {k: v.astype(float) for k, v in gru.fresh(rng.random((3, 4)) + 0.1, 1.0, 6).items()}
    stream = rng.integers(0, 13, 4 * 3 * gru.WINDOW)
    got, loss = gru.train(w, stream, 2, streams=4)
    goal = stream.reshape(4, -1).T
    ids = np.concatenate([np.full((1, 4), 2), goal[:-1]])
    one, two, h, losses = {k: 0.0 for k in w}, {k: 0.0 for k in w}, np.zeros((4, 6)), []
    for i in range(3):
        at = slice(i * gru.WINDOW, (i + 1) * gru.WINDOW)
        grad, h, each = gru.gradient(w, h, ids[at], goal[at], ids[at] == 2)
        losses.append(each)
        norm = np.sqrt(sum((g ** 2).sum() for g in grad.values()))
        for k, g in grad.items():
            g = g * min(1, 1 / norm)
            one[k], two[k] = 0.9 * one[k] + 0.1 * g, 0.99 * two[k] + 0.01 * g * g
            w[k] = w[k] - 0.01 * one[k] / (1 - 0.9 ** (i + 1)) / (np.sqrt(two[k] / (1 - 0.99 ** (i + 1))) + 1e-8)
    assert loss == pytest.approx(np.mean(losses), rel=1e-5)
    for k in w:
        assert got[k] == pytest.approx(w[k], rel=1e-3, abs=1e-5), k

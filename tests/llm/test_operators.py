"""Each operator against brute force on small inputs, and on tables with every kind of odd row."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logspark.llm import dedup, jaccard, langid, license_scan, mixing, ngram_lm, packing, quality, token_store, url_filter, words

SF = "/root/testdata/sf0.001"
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    return pytest.importorskip("public_tokenizers").path(TOKENIZER)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


# ---------------------------------------------------------------- odd tables

EVERY = {
    "dedup": lambda d: dedup.exact_dedup(d),
    "jaccard": lambda d: jaccard.near_components(d),
    "quality": lambda d: quality.quality_verdicts(d),
    "langid": lambda d: langid.identify_languages(d),
    "ngram_lm": lambda d: ngram_lm.score_documents(d),
    "mixing": lambda d: mixing.mix_plan(d),
    "tokens": lambda d: token_store.encode_documents(d, tokenizer_path()),
    "packing": lambda d: packing.pack_documents(d, capacity=100_000),
    "packing in order": lambda d: packing.pack_documents(d, capacity=100_000, order=["row"]),
    "license": lambda d: license_scan.scan_licenses(d.withColumn("path", d["source"])),
}


@pytest.mark.parametrize("name", EVERY)
def test_odd_rows_have_one_result_each(odd, name):
    out = EVERY[name](odd).collect()
    assert len(out) == odd.count()
    assert sorted((r["doc_id"] for r in out), key=str) == sorted((r["doc_id"] for r in odd.collect()), key=str)


@pytest.mark.parametrize("name", EVERY)
def test_empty_tables(odd, name):
    assert EVERY[name](odd.limit(0)).count() == 0


def test_stages_keep_columns(odd):
    for stage in (dedup.keep_one, jaccard.keep_first, quality.keep_good, mixing.mixed):
        out = stage(odd)
        assert out.columns == odd.columns
        assert stage(odd.limit(0)).count() == 0
    assert mixing.mixed(odd).count() == odd.count()
    assert dedup.keep_one(odd).count() == 8  # one of three copies, one of two null or empty texts with different ids, and so on
    assert packing.packed_sequences(odd.limit(0)).count() == 0


def test_clean_rows_with_missing_and_repeated_ids_survive(spark):
    rng = np.random.default_rng(8)
    clean = lambda: " ".join(f"word{k}" for k in rng.integers(0, 10**6, size=60))
    rows = [(None if i % 3 == 0 else i % 3, clean(), "en", "s") for i in range(30)]
    junk = [(None, "too short", "en", "s"), (1, "short too", "en", "s")]
    schema = "doc_id long, text string, lang string, source string"
    got = quality.keep_good(spark.createDataFrame(rows + junk, schema))
    assert sorted(got.collect(), key=str) == sorted(spark.createDataFrame(rows, schema).collect(), key=str)
    # near copies: of a row without id, of one of several rows of an id, and of each other without any id
    copies = [(7, rows[0][1] + " a", "en", "s"), (0, rows[1][1] + " b", "en", "s"), (None, rows[3][1] + " c", "en", "s")]
    left = {r["text"] for r in jaccard.keep_first(spark.createDataFrame(rows + copies, schema)).collect()}
    families = [{rows[0][1], copies[0][1]}, {rows[1][1], copies[1][1]}, {rows[3][1], copies[2][1]}]
    assert left >= {t for _, t, _, _ in rows} - set().union(*families)
    assert copies[0][1] in left and copies[1][1] in left and all(len(left & f) == 1 for f in families)


# ---------------------------------------------------------------- exact dedup


def test_dedup_matches_grouping(docs, texts):
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    for r in dedup.exact_dedup(docs).collect():
        same = groups[texts[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(same), len(same), r["doc_id"] == max(same))
        assert r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    small = {r["doc_id"]: r["keep_id"] for r in dedup.exact_dedup(docs, keep="smallest").collect()}
    assert all(small[i] == min(groups[t]) for i, t in texts.items())


def test_dedup_index_merges_runs(spark, docs, texts):
    index = dedup.DigestIndex(spark, buckets=3)
    index.flush(docs.filter("doc_id % 2 = 0"), memtables=2)
    index.flush(docs.filter("doc_id % 2 = 1"))
    a, b = map(index.run, index.levels[0][:2])
    plan = a.join(b.hint("merge"), "digest", "full")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # runs are bucketed alike
    level1 = index.compact()
    assert {r["digest"].hex(): (r["keep_id"], r["group_size"]) for r in map(lambda r: {**r.asDict(), "digest": bytes(r["digest"])}, level1.collect())} == {
        hashlib.sha256(t.encode()).hexdigest(): (max(i for i, x in texts.items() if x == t), sum(x == t for x in texts.values())) for t in texts.values()
    }
    digest = hashlib.sha256(texts[7].encode()).digest()
    found = index.find([digest])
    assert [r["keep_id"] for r in found.collect()] == [max(i for i, x in texts.items() if x == texts[7])]
    assert "PushedFilters: [" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "EqualTo(digest" in plan or "In(digest" in plan
    assert index.find([b"none"]).count() == 0


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_texts_that_share_a_digest_stay_apart(spark, keep):
    """A digest of one hex digit clashes for most texts: the texts decide, repeated and missing ids included."""
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, "b"), (None, "b"), (None, "c"), (None, "c"), (4, None), (5, ""), (6, "d")]
    rows += [(10 + i, f"text {i % 20}") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = dedup.exact_dedup(frame, keep=keep, digest=lambda t: F.unhex(F.concat(F.lit("0"), F.substring(F.sha2(t, 256), 1, 1)))).collect()
    assert len(out) == len(rows) and all(r["kept"] is not None for r in out)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    for r in out:
        same = groups[r["text_sha256"]] if len(r["text_sha256"]) == 64 else None
        if same:
            known = [i for i in same if i is not None]
            assert (r["keep_id"], r["group_size"]) == ((max if keep == "largest" else min)(known, default=None), len(same))
    assert sum(r["kept"] for r in out) == len(groups)


# --------------------------------------------------------------- near copies


def brute_components(texts: dict, percent: int = 80) -> dict:
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), len(sets[i])) for i in sets}


def test_components_match_all_pairs(docs, texts):
    want = brute_components(texts)
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in jaccard.near_components(docs).collect()} == want


def test_components_of_a_family_without_centre(spark):
    """Copies of one base with edits of their own: many share the frequent shingles, few pairs link, lists are long and in blocks."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = {}
    for i in range(90):
        own = list(base)
        for place in rng.choice(150, size=int(rng.integers(1, 5)), replace=False):
            own[place] = f"e{i}x{place}"
        rows[i] = " ".join(own)
    small = jaccard.Settings(short_list=4, block=16, frequent=3)
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in jaccard.near_components(frame, small).collect()}
    assert got == brute_components(rows)


def test_components_of_a_family_with_repeated_ids(spark):
    """Every id stands for a text of the family and for one of another kind: long lists find the right one."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        own = list(base)
        for place in rng.choice(150, size=int(rng.integers(1, 5)), replace=False):
            own[place] = f"e{i}x{place}"
        rows += [(i, " ".join(f"other{i}x{k}" for k in range(40))), (i, " ".join(own))]
    small = jaccard.Settings(short_list=4, block=16, frequent=3)
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = brute_components({k: t for k, (_, t) in enumerate(rows)})
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_components(frame, small).collect())
    assert got == collections.Counter((i, want[k][1], rows[want[k][0]][0]) for k, (i, _) in enumerate(rows))


def test_a_block_takes_the_text_of_the_class():
    import pandas as pd
    import pyarrow as pa

    a, b = (" ".join(f"w{k}" for k in range(60)) + end for end in (" x", " y"))
    x, y = (jaccard.set_hash(t) for _, t in jaccard._texts(pa.RecordBatch.from_pydict({"text": [a, b]}), 5))
    wrong = "another text of the same id that is long enough to have shingles"
    block = pd.DataFrame({"cls": [x, x, y, y], "grp": [x, x, y, y], "text": [wrong, a, wrong, b]})
    assert jaccard._within(jaccard.Settings())(block).values.tolist() == [[x, y]]


@given(st.lists(st.text(alphabet="aB \t\n\r\x0b\x0cé1", max_size=40) | st.none(), max_size=8))
@settings(max_examples=60, deadline=None)
def test_word_hashes_follow_words(column):
    import pyarrow as pa

    seen, got = {}, []
    for first, end, hashed, at in words.slices(pa.array(column, pa.string())):
        got += [hashed[at[i] : at[i + 1]].tolist() for i in range(end - first)]
    for text, hashes in zip(column, got, strict=True):
        split = (text or "").encode().lower().split()
        assert len(split) == len(hashes)
        for w, h in zip(split, hashes, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
@settings(max_examples=50, deadline=None)
def test_packed_integers_round_trip(values):
    a = np.sort(np.array(values, dtype=np.uint64))
    assert (words.unpack(words.pack(a, delta=True), np.uint64, delta=True) == a).all()


# -------------------------------------------------------------------- tokens


def test_tokens_round_trip(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer

    whole, path = Tokenizer.from_file(tokenizer_path()), f"file://{tmp_path}/tokens"
    token_store.write_tokens(docs, path, tokenizer_path())
    got = {r["doc_id"]: r for r in token_store.token_digests(spark, path).collect()}
    stored = {r["doc_id"]: r["ids"] for r in token_store.read_tokens(spark, path).collect()}
    start = 0
    for i in sorted(texts):
        ids = [*whole.encode(texts[i], add_special_tokens=False).ids, 1]
        assert stored[i] == ids
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r["doc_id"] for r in token_store.read_tokens(spark, path, [7]).collect()] == [7]
    plan = token_store.read_tokens(spark, path, [7])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan or "EqualTo(doc_id,7)" in plan


@pytest.mark.parametrize("text", ["", "  ", "İ. x", "don't it's 'S", "<|endoftext|> x<|endoftext|>.", "Σας. ΣΑΣ", "x\x1c.y", "a..b,.", "ﬁ. ½ 12.5", "e\u0301 x \u0301", "你好，世界。", "a\u3000b", "a\u0301\x0b\u0301b", "x\x1c\x1d y\u2028z\xa0'll", "İ I\u0307 ΑΣ ΑΣ.", "it 's 't\t'", "<|startoftext |> <|endoftext|"])
def test_word_encoder_equals_the_tokenizer(text):
    enc = token_store.encoder(tokenizer_path())
    assert enc.apart and enc.encode(text) == enc.whole(text)


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_any_text_has_the_ids_of_the_tokenizer(text):
    enc = token_store.encoder(tokenizer_path())
    assert enc.encode(text) == enc.whole(text)


# ---------------------------------------------------------------------- urls


def brute_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_url_verdicts(spark):
    urls = ["http://WWW.Example.com/en/1?x#y", "https://a.example.com/en/", "http://example.com", "http://com/x", "x.net/es/", "http://b.net/es/q", "http://net/fr/", "http://badexample.com/en/", None, "", "http://", "ftp://u@h.com:80/a#b", "a://b://c.com/en/", "http://x.com?/en/", "http://example.com/en"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(3, urls[3], "again")], "page_id long, url string, html string")
    got = collections.defaultdict(list)
    for r in url_filter.url_verdicts(pages).collect():
        got[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert len(got[3]) == 2
    for i, u in enumerate(urls):
        assert got[i][0] == brute_verdict(u), u
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0
    clashing = pages.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "row", "suffix", "prefix", "verdict", "short", "digest", "size")})
    assert sorted(url_filter.url_verdicts(clashing).collect(), key=str) == sorted(url_filter.url_verdicts(pages).collect(), key=str)


# ------------------------------------------------------------------- licences


def test_license_lines_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.txt", "nothing to see here at all"), (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/d/e.txt", "plain words"), (5, "z/e.txt", "plain words"), (6, "z/f.txt", "words words words words words words words words\nLicensed under CC BY-NC 4.0.\nmore words"), (7, None, None),
    ]
    got = {r["doc_id"]: (r["license"], r["origin"], r["from_dir"]) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("Apache-2.0", "inherited", "a/b"), 3: ("Apache-2.0", "own", None), 4: ("Apache-2.0", "inherited", "a/b"), 5: (None, "none", None), 6: ("CC-BY-NC-4.0", "own", None), 7: (None, "none", None)}


def test_embedded_wrapped_and_full_licenses(spark):
    prose = " ".join(f"our project is the one that we use for work number {k}." for k in range(4))
    wrapped = "/* Redistribution and use in source and binary\n * forms, with or without modification,\n * are permitted provided that the\n * following conditions are met */"
    full = license_scan.full_texts()
    want = {0: "GPL-3.0", 1: "GPL-3.0", 2: "BSD-3-Clause", 3: None}
    rows = [(0, "Our project is licensed under the GNU General Public License, version 3."), (1, f"{prose} This work is licensed under the GNU General Public License, version 3. {prose}"), (2, f"{prose}\n{wrapped}\n{prose}"), (3, prose)]
    for i, (name, (text,)) in enumerate(sorted(full.items())):
        rows.append((10 + i, " ".join(text.split())))  # all on one line
        want[10 + i] = name
    rows += [(100 + i, f"our project is the one number {i} we use") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("path", F.lit("x"))
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(frame).collect()}
    assert {i: got[i]["license"] for i in want} == want
    assert all(got[i]["similarity"] > 0.99 for i in want if i >= 10)
    assert not any(got[100 + i]["license"] for i in range(3000))


@pytest.mark.parametrize("a_line", [1, 2, 3])
def test_notices_at_few_words_a_line(spark, a_line):
    wrap = lambda t: "\n".join(" ".join(w) for w in (t.split()[k : k + a_line] for k in range(0, len(t.split()), a_line)))
    want = {i: (name, f"Some words come first.\n{wrap(t)}\nand some follow it") for i, (name, t) in enumerate((n, t) for n, ts in license_scan.TEMPLATES.items() for t in ts)}
    rows = [(i, t) for i, (_, t) in want.items()] + [(100 + i, f"ordinary words number {i} of the text, such as it is") for i in range(300)]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("path", F.lit("x"))).collect()}
    assert {i: got[i] for i in want} == {i: name for i, (name, _) in want.items()}


def test_licenses_match_all_cosines(spark, docs, texts):
    """Every window of every text against every notice, and every text against every full text, by plain counts."""
    terms = {i: license_scan._terms(t) for i, t in texts.items()}
    df = collections.Counter(t for c in terms.values() for t in c)

    def unit(c):
        w = {t: k * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    most = license_scan.LONGEST * max(sum(license_scan._terms(t).values()) for ts in license_scan.TEMPLATES.values() for t in ts)
    notices = [(name, unit(license_scan._terms(t))) for name, ts in license_scan.TEMPLATES.items() for t in ts]
    full = [(name, unit(license_scan._terms(t))) for name, (t,) in license_scan.full_texts().items()]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs.withColumn("path", F.lit(None).cast("string"))).collect()}
    for i, t in texts.items():
        segs = [c for c in map(license_scan._terms, license_scan.re.split(license_scan.SEGMENT, t)) if c]
        units = [(terms[i], full)] if terms[i] else []
        for a in range(len(segs)):
            for b in range(a, len(segs)):
                if b - a >= license_scan.SPAN and sum(sum(c.values()) for c in segs[a : b + 1]) > most:
                    break
                units.append((sum(segs[a : b + 1], collections.Counter()), notices))
        found = [(round(sum(x * v.get(w, 0) for w, x in unit(c).items()), 9), name) for c, vectors in units for name, v in vectors]
        best = max((f for f in found if f[0] >= license_scan.THRESHOLD), default=None)
        assert (got[i]["origin"] == "own") == (best is not None)
        if best:
            assert got[i]["license"] == best[1] and got[i]["similarity"] == pytest.approx(best[0], abs=2e-6)


# -------------------------------------------------------------------- quality


def test_statistics_match_plain_counts(spark, docs, texts):
    got = {r["doc_id"]: r for r in quality.quality_verdicts(docs).collect()}
    for i, t in texts.items():
        w = [x.decode() for x in t.encode().split()]
        seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_statistics_match_sql(spark, docs):
    """The counts by DuckDB, over whole texts."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, coalesce(text, '') AS text FROM '{SF}/documents.parquet'")
    want = con.execute(r"""
        WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
        g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
        t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
        r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM t, range(8) s(k) GROUP BY doc_id)
        SELECT w.doc_id, len(words), list_sum(list_transform(words, lambda x: length(x)))::BIGINT, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), len(lines) - len(list_distinct(lines)), coalesce(r.n, 0)
        FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) ORDER BY 1""").fetchall()
    got = quality.quality_verdicts(docs).orderBy("doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert [tuple(r) for r in got] == [(i, n, c or 0, s, d, k) for i, n, c, s, d, k in want]


def test_outliers_go_and_the_rest_stays(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "en", "s", float(rng.normal(5, 1)), float(rng.normal(1.7, 0.1)), 0.0, 0.0) for i in range(600)] + [(900 + i, "en", "s", 5.0, 1.7, 1.7, 0.0) for i in range(20)]
    out = quality.outliers(spark.createDataFrame(rows, "doc_id long, group_lang string, group_source string, f_words double, f_length double, f_symbols double, f_lines double"))
    verdict = {r["doc_id"]: r["d2"] <= quality.CUTOFF for r in out.collect()}
    assert len(verdict) == 620 and not any(verdict[900 + i] for i in range(20)) and all(verdict[i] for i in range(600))


def test_small_groups_are_judged_by_wider_fits(spark):
    """Own fit of 30 rows, a language's fit for groups of 5 rows, and the fit of all for a language of 3 rows."""
    rng = np.random.default_rng(4)
    f = lambda words=5.0: (float(rng.normal(words, 0.3)), float(rng.normal(1.7, 0.1)), 0.0, 0.0)
    bad = (5.0, 1.7, 1.9, 0.0)
    rows = [(i, "en", "big", *f()) for i in range(30)] + [(100 + i, "de", f"s{i // 5}", *f(9.0)) for i in range(40)] + [(200 + i, "fr", "s", *f()) for i in range(3)]
    rows += [(900, "en", "big", *bad), (901, "de", "s3", *bad), (902, "fr", "s", *bad)]
    schema = "doc_id long, group_lang string, group_source string, f_words double, f_length double, f_symbols double, f_lines double"
    verdict = {r["doc_id"]: r["d2"] <= quality.CUTOFF for r in quality.outliers(spark.createDataFrame(rows, schema)).collect()}
    assert len(verdict) == len(rows) and {i for i, kept in verdict.items() if not kept} == {900, 901, 902}


def test_outliers_of_the_smallest_table_go(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality.quality_verdicts(docs).filter("NOT base_failed").join(labels, "doc_id").select("quality", "kept").collect()
    bad, good = [r["kept"] for r in judged if r["quality"] == 0], [r["kept"] for r in judged if r["quality"] == 1]
    assert bad and not any(bad) and good and all(good)


# ------------------------------------------------------------------ languages


def test_every_labelled_language_is_learned(spark):
    """Five hundred languages, each of letters of its own."""
    word = lambda k, j: "".join(chr(0x4E00 + 7 * k + (j + i) % 5) for i in range(4))
    rows = [(k * 10 + j, " ".join(word(k, j + i) for i in range(8)), f"l{k}") for k in range(500) for j in range(6)]
    got = langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {i: x for i, _, x in rows}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) > 0.98 * len(rows) and len({r["lang_pred"] for r in got}) >= 499


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")  # some hundred labelled texts to learn from
    right = docs.select("doc_id", "lang").join(langid.identify_languages(docs), "doc_id").collect()
    held = [r for r in right if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in right)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in right)


def test_kernel_predictions_match_plain_sets():
    """Kernel values from sets of substrings, and ridge regression on them, give the margins that the folded weights give."""
    texts = {"aa": ["the cat sat on the mat", "a dog and the cat 12", "then that hat"], "bb": ["le chat noir et le chien", "la maison \U0001d400 et été", "les chats, les chiens"]}

    def plain(t):
        letters = "".join(c if c.isalpha() else "\x01" for c in t.lower())
        while "\x01\x01" in letters:
            letters = letters.replace("\x01\x01", "\x01")
        return {letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1)}

    every = [t for v in texts.values() for t in v]
    model = langid.train({k: [langid.grams_of(t) for t in v] for k, v in texts.items()})
    assert all(len(langid.grams_of(t)) == len(plain(t)) for t in every)
    k = lambda a, b: len(plain(a) & plain(b)) / math.sqrt(len(plain(a)) * len(plain(b)))
    cross = np.array([[k(a, b) for b in every] for a in every])
    values, vectors = np.linalg.eigh(cross)
    root = vectors[:, values > values.max() * 1e-7] / np.sqrt(values[values > values.max() * 1e-7])
    phi, y = cross @ root, np.where(np.arange(6)[:, None] // 3 == np.arange(2), 1.0, -1.0)
    x = np.concatenate([phi - phi.mean(axis=0), np.ones((6, 1))], axis=1)
    penalty = np.diag([*[6e-3] * phi.shape[1], 0.0])
    beta = np.linalg.solve(x.T @ x + penalty, x.T @ y)
    for t in [*every, "the chat", "zzz", "", None, "12"]:
        names, scores = langid.predict([t], model)
        if not t or t == "12":
            assert (names, scores) == (["und"], [0.0])
            continue
        row = np.array([k(t, b) for b in every]) @ root - phi.mean(axis=0)
        margin = row @ beta[:-1] + beta[-1]
        share = np.exp(4 * (margin - margin.max()))
        assert names[0] == "ab"[margin.argmax()] * 2 and scores[0] == pytest.approx((share / share.sum()).max(), abs=1e-4)


# ------------------------------------------------------------------ mixing


def test_schedule_stays_within_a_block():
    for weights in ({"a": 5, "b": 3, "c": 2}, {"x": 1}, {f"s{i}": i + 1.5 for i in range(17)}):
        parts = mixing.quantise(weights, 200)
        plan = mixing.period_schedule(parts)
        d, got = sum(parts.values()), collections.Counter()
        assert [t for _, _, t, _, _ in plan] == list(range(d))
        for s, k, slot, release, deadline in plan:
            assert release <= slot < deadline and k == got[s]
            got[s] += 1
            assert all(abs(got[x] - (slot + 1) * parts[x] / d) < 1 for x in parts)


def test_mix_meets_its_targets(spark):
    """Up to the horizon each source has had its target share to within a block; sources without a target share the rest."""
    rows = [(i, "abcd"[min(i % 17, 3)]) for i in range(4000)] + [(5000 + i, None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    targets = {"a": 0.5, "b": 0.2, "none": 0.9}
    out = mixing.mix_plan(docs, targets, block_rows=5, period=100).collect()
    sizes = collections.Counter("\x00" if s is None else s for _, s in rows)
    weights = mixing.target_weights(dict(sizes), targets)
    assert weights["a"] == 0.5 and weights["b"] == 0.2 and sum(weights.values()) == pytest.approx(1)
    parts = mixing.quantise(weights, 100)
    slots = {r["slot"]: r["source"] or "\x00" for r in out if r["on_target"]}
    assert sorted(slots) == list(range(len(slots))) and len(slots) >= 200 // 5 * 2
    got = collections.Counter()
    for t in range(len(slots)):
        got[slots[t]] += 1
        assert all(abs(got[s] - (t + 1) * parts[s] / 100) < 1 for s in parts), t
    # the first slot after them belongs to a source that has no full block left
    late = [r for r in out if not r["on_target"]]
    assert len(late) + 5 * len(slots) == len(rows) and {r["doc_id"] for r in out} == {i for i, _ in rows}
    # with blocks of their own for two sources only, the others share theirs
    few = mixing.mix_plan(docs, block_rows=5, own=2).collect()
    assert len(few) == len(rows) and len({(r["slot"], r["place"]) for r in few}) == len(rows)


def test_mix_never_folds_a_source_with_a_target(spark):
    rows = [(i, s) for i, s in enumerate(["big"] * 90 + ["mid"] * 50 + ["small"] * 12 + [f"rest{k}" for k in range(30)])]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    out = mixing.mix_plan(docs, {"small": 0.3}, block_rows=1, own=2).collect()
    weights = {r["source"]: r["weight"] for r in out}
    assert weights["small"] == pytest.approx(300, abs=2) and {r["source"] for r in out} == {s for _, s in rows} and len(out) == len(rows)


def test_mix_ranks_every_row_once(docs):
    rows = mixing.mix_plan(docs, block_rows=3).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["block"], r["place"]))
    assert all(sorted(v) == [(i // 3, i % 3) for i in range(len(v))] for v in by.values())
    assert len({(r["slot"], r["place"]) for r in rows}) == len(rows)


# ------------------------------------------------------------------- packing


def slow_best_fit(lengths, sources, clusters, capacity):
    bins, placed = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= lengths[i] and (sources[i] < 0 or sources[i] not in b["s"]) and (clusters[i] < 0 or clusters[i] not in b["c"])]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"room": capacity, "s": set(), "c": set()})
        placed[i] = (k, capacity - bins[k]["room"])
        bins[k]["room"] -= lengths[i]
        bins[k]["s"].add(sources[i])
        bins[k]["c"].add(clusters[i])
    return placed


@given(st.lists(st.tuples(st.integers(1, 30), st.integers(-1, 4), st.integers(-1, 6)), max_size=60))
@settings(max_examples=80, deadline=None)
def test_best_fit_takes_the_tightest_compatible_bin(items):
    columns = [list(c) for c in zip(*items, strict=True)] or [[], [], []]
    assert packing.best_fit(*columns, 30) == slow_best_fit(*columns, 30)


def test_packing_keeps_every_word(docs, texts):
    pieces = packing.pack_documents(docs, capacity=300, group_rows=50).collect()
    total, fill, held = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    for p in pieces:
        total[p["doc_id"]] += p["length"]
        if p["bin_id"]:
            fill[p["bin_id"]] += p["length"]
            held[p["bin_id"]].append(source[p["doc_id"]])
            assert p["bin_offset"] + p["length"] <= 300
    assert total == collections.Counter({i: len(t.encode().split()) for i, t in texts.items()})
    assert max(fill.values()) <= 300 and all(len(set(s)) == len(s) for s in held.values())


# ------------------------------------------------------------ language model


@given(st.lists(st.integers(0, 2**40), max_size=60), st.lists(st.integers(0, 2**40), max_size=20))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, asked):
    v = np.sort(np.array(values, dtype=np.uint64))
    seq = ngram_lm.EliasFano.of(v, 2**41)
    assert (seq[np.arange(len(v))] == v).all() if len(v) else seq.size == 0
    assert (seq.successor(np.array(asked, dtype=np.uint64)) == np.searchsorted(v, np.array(asked, dtype=np.uint64))).all()
    assert ((seq.find(np.array(asked, dtype=np.uint64)) >= 0) == np.isin(asked, v)).all()


def test_elias_fano_over_many_blocks():
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 2**20, 50_000), rng.integers(0, 2**50, 50_000), np.repeat(np.arange(40), 999), np.arange(5_000) * 3):
        v = np.sort(values).astype(np.uint64)
        seq = ngram_lm.EliasFano.of(v, int(v[-1]) + 1)
        asked = np.concatenate([v[::7], v[::11] + np.uint64(1), rng.integers(0, 2**51, 1000).astype(np.uint64)])
        assert (seq[np.arange(len(v))] == v).all() and (seq.successor(asked) == np.searchsorted(v, asked)).all()


@pytest.mark.parametrize("spread", [4, 10_000])
def test_language_model_matches_plain_counts(docs, texts, spread):
    s = ngram_lm.Settings(spread=spread, block_tokens=5_000)
    got = {r["doc_id"]: r for r in ngram_lm.score_documents(docs, s).collect()}
    tokens = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    grams = lambda w: list(zip([0, 0, *w[:-2]][: len(w)], [0, *w[:-1]], w, strict=True))
    one, two, three, middle, both = (collections.Counter() for _ in range(5))
    for i, w in tokens.items():
        if not held[i]:
            one.update(w)
            for a, b, c in grams(w):
                two[b, c] += 1
                three[a, b, c] += 1
                middle[b] += 1
                both[a, b] += 1
    n, v = sum(one.values()), len(one)
    for i, w in tokens.items():
        u = [(one[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
        model = 0.0
        for (a, b, c), q in zip(grams(w), u, strict=True):
            p = (two[b, c] + s.prior * q) / (middle[b] + s.prior)
            model += math.log10((three[a, b, c] + s.prior * p) / (both[a, b] + s.prior))
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(one[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(map(math.log10, u)), rel=1e-9)
        assert r["score"] == pytest.approx(model, abs=2e-4 * len(w))


def test_exact_dedup_leaves_no_tables(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    assert dedup.keep_one(docs).count() > 0 and dedup.exact_dedup(docs).count() > 0
    assert {t.name for t in spark.catalog.listTables()} == before

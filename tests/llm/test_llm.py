"""Operators for training data against brute force, round trips, libraries and edge cases."""

import collections
import hashlib
import json
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from waylake.llm import langid, line_dedup, mpeg_audio, packing, pieces, pii, quality, registry, rollup, simhash, token_files
from waylake.llm.tokens import WordBpe

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators give to their own columns.
CLASH = ["_q", "_g", "_lang", "_failed", "_kept", "_mcd_m", "_salt", "_pii", "_terms", "_th", "_doc_id", "_gone", "_n_lines", "_keep_id", "row", "key", "terms", "k", "gone", "k_doc", "repeats", "fingerprint", "component_id", "n_words", "kept", "base_failed", "length", "start", "spans", "th", "norm", "_src", "n", "lo", "rank", "part", "score"]
LONG = "word " * 30_000 + "x" * 50_000
HARD = [
    (1, "", "en", "a", 0), (2, None, None, None, None), (3, "same text of a few words here", "en", "a", 1), (4, "same text of a few words here", None, "a", 1),
    (4, "same text of a few words here", None, "a", 1), (None, "no id but some words in it", "fr", None, 2), (6, " \n\t\n ", "de", "b", 3),
    (7, LONG, "en", "b", len(LONG)), (8, "É 日本語 😀 \u0000 |endoftext| <|endoftext|> it's", "xx", "c", 9), (9, "a@b.co +1 234 567 8901 4111 1111 1111 1111 1.2.3.4", "en", "c", 9),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def local(docs):
    return docs.toPandas().sort_values("doc_id")


@pytest.fixture(scope="module")
def hard(spark):
    df = spark.createDataFrame(HARD, SCHEMA)
    for name in CLASH:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(open(WORD_BPE).read())


def one_column_each(df, n=None):
    found = df.collect()
    assert n is None or len(found) == n
    return found


# every operator takes hard rows and an empty table


OPERATORS = {
    "language": langid.predict,
    "simhash": simhash.near_duplicates,
    "quality": quality.judge,
    "pii": pii.find,
    "packing": lambda df: packing.pack(df, WORD_BPE),
    "pieces": lambda df: pieces.round_trip(df, PIECE_BPE),
    "spans": lambda df: pieces.encode_documents(df, PIECE_BPE),
    "media": lambda df: mpeg_audio.digest_media(mpeg_audio.to_media(df)),
    "lines": line_dedup.deduplicate,
    "lines by edits": lambda df: line_dedup.deduplicate(df, by_edits=True),
    "filter": quality.filter_documents,
    "sanitise": pii.sanitise,
    "keep one": simhash.keep_one,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(name, hard):
    found = OPERATORS[name](hard).collect()
    if name in ("filter", "keep one", "packing"):
        assert found
    else:
        assert len(found) == len(HARD)


@pytest.mark.parametrize("name", ["lines", "lines by edits", "filter", "sanitise", "keep one"])
def test_columns_with_clashing_names_survive(name, hard):
    found = OPERATORS[name](hard)
    assert found.columns[: len(hard.columns)] == hard.columns
    for r in found.collect():
        assert all(r[c] == "clash" for c in CLASH) and (r["doc_id"] is not None or r["lang"] == "fr")


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_take_hard_rows(spark, hard, sf, k):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    found = stage(spark, hard, sf)
    rows = found.collect()
    assert rows and {r["doc_id"] for r in rows} <= {r[0] for r in HARD}
    if k < 4:
        assert found.columns == corpus_pipeline.COLUMNS
    if k in (1, 3):
        assert len(rows) == len(HARD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, hard):
    assert OPERATORS[name](hard.limit(0)).collect() == []


def test_token_files_hard(spark, hard, tmp_path, bpe):
    path = str(tmp_path / "ids")
    token_files.write_token_files(hard, path, WORD_BPE)
    index = token_files.token_index(spark, path).orderBy("start").collect()
    assert len(index) == len(HARD) and index[0]["doc_id"] is None
    assert [r["start"] for r in index] == list(np.cumsum([0] + [r["n_tokens"] for r in index])[:-1])
    empty = str(tmp_path / "none")
    token_files.write_token_files(hard.limit(0), empty, WORD_BPE)
    assert token_files.token_index(spark, empty).collect() == []


# 1 language


def test_language(docs, local):
    found = {r["doc_id"]: r for r in langid.predict(docs).collect()}
    hits = [found[i]["lang_pred"] == x for i, x in zip(local.doc_id, local.lang) if found[i]["held_out"]]
    assert len(hits) > 20 and np.mean(hits) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())


def test_repeated_rows_take_no_sample_rows(spark, docs):
    plain = langid.training_texts(docs)
    first = docs.where("lang = 'en' and doc_id is not null").orderBy(F.xxhash64("doc_id")).limit(40)
    again = docs.union(first.join(spark.range(30).select(F.lit(1).alias("x")), F.lit(True)).select(*docs.columns))
    assert langid.training_texts(again) == plain and len(plain["en"]) > 5


def test_language_with_long_texts_only(spark):
    rows = [(i, f"short words {i}", "en") for i in range(20)] + [(20 + i, "1 2 " * 2000 + "langes Wort " * 2000, "de") for i in range(20)]
    df = spark.createDataFrame([*rows, (40, "1234", "xx")], "doc_id long, text string, lang string")
    texts = langid.training_texts(df)
    assert set(texts) == {"en", "de"} and all(t.startswith("langes") and len(t) == 3750 for t in texts["de"])
    assert [r["lang_pred"] for r in langid.predict(df).orderBy("doc_id").collect()] == ["en"] * 20 + ["de"] * 20 + ["und"]


def test_cross_parse_is_the_longest_match_parse(local):
    parser = langid.CrossParser(json.dumps({"en": list(local.text[local.lang == "en"][:8]), "fr": list(local.text[local.lang == "fr"][:8])}))
    references = {k: " ".join(map(langid.normalised, local.text[local.lang == k][:8])) for k in ("en", "fr")}

    def phrases(text, reference, block=1024):
        n = 0
        for at in range(0, len(text), block):
            part, i = text[at : at + block], 0
            while i < len(part):
                k = 1
                while i + k <= len(part) and part[i : i + k] in reference:
                    k += 1
                i, n = i + max(1, k - 1), n + 1
        return n

    for text in [*local.text[8:14], "İstanbul, ÜBER!", "  a 1 b  ", "日本 x"]:
        codes, letters = parser.codes(text)
        plain = langid.normalised(text)
        assert len(codes) == len(plain) and letters == len(plain) - plain.count(" ")
        got = parser.phrases([codes[a : a + 1024] for a in range(0, len(codes), 1024)]).sum(axis=0)
        assert got.tolist() == [phrases(plain, references[k]) for k in parser.langs]
        # blocks that continue a text don't begin a phrase
        for size in (1, 7, 64):
            cut = [codes[a : a + size] for a in range(0, len(codes), size)]
            got = parser.phrases(cut, [k > 0 for k in range(len(cut))]).sum(axis=0)
            assert got.tolist() == [phrases(plain, references[k], 1 << 40) for k in parser.langs]
    assert parser.predict(["123 ...", None, ""]) == [("und", 0.0)] * 3


def test_language_with_many_letters():
    """Letters beyond the table's, with the memory that the table takes."""
    rnd = np.random.default_rng(2)
    text = "".join(chr(0x4E00 + int(x)) for x in rnd.integers(0, 3000, 8000))
    parser = langid.CrossParser(json.dumps({"zz": [text], "en": ["some plain words of a language " * 20]}))
    machine = parser.machines[parser.langs.index("zz")]
    assert sum(a.nbytes for a in (machine.table, machine.keys, machine.next, machine.first)) < 10_000_000
    probe = text[50:90] + text[7000:7003] + "x" + text[:30]
    n, i = 0, 0
    while i < len(probe):
        k = 1
        while i + k <= len(probe) and probe[i : i + k] in text:
            k += 1
        i, n = i + max(1, k - 1), n + 1
    codes, _ = parser.codes(probe)
    assert parser.phrases([codes])[0][parser.langs.index("zz")] == n
    assert parser.predict([text[300:500]])[0][0] == "zz"


# 2 and 3 tokens


def test_token_files_of_repeated_ids(spark, tmp_path, bpe):
    """Positions follow the order in which ids are stored, also for rows with one doc_id."""
    rows = [(1, "a b c d e f g h"), (1, "b"), (1, None), (2, "x y"), (2, "a")]
    path = str(tmp_path / "ids")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, WORD_BPE)
    stored = [r for r in token_files.read_token_files(spark, path).orderBy("doc_id", "row").collect()]
    index = {r["start"]: (r["doc_id"], r["ids_crc32"]) for r in token_files.token_index(spark, path).collect()}
    at = 0
    for r in stored:
        assert index[at] == (r["doc_id"], zlib.crc32(np.array(r["ids"], "<u4").tobytes()))
        at += r["n_tokens"]


def test_fast_encoding_is_the_library(bpe, local):
    texts = [*local.text[:150], "it's 'll DON'T", "<|endoftext|> a", "ÀÖ×÷ ßÿ", "a\x0bb", "١٢ İ Σς", "<| x |>", "", "==a1b2=="]
    assert [x.tolist() for x in bpe.encode(texts)] == [e.ids for e in bpe.library.encode_batch(texts, add_special_tokens=False)]


def test_words_built_to_collide(bpe):
    """Thue-Morse strings have equal polynomial hashes modulo 2^64, whatever the base."""
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    assert [x.tolist() for x in bpe.encode([a, b])] == [e.ids for e in bpe.library.encode_batch([a, b], add_special_tokens=False)]


def test_token_files(spark, docs, local, tmp_path, bpe):
    path = str(tmp_path / "ids")
    token_files.write_token_files(docs.repartition(5), path, WORD_BPE, row_index_stride=1000)
    want = [np.append(x, 1).astype("<u4") for x in bpe.encode(list(local.text))]
    got = token_files.token_index(spark, path).toPandas().sort_values("doc_id")
    assert got.n_tokens.tolist() == [len(x) for x in want]
    assert got.start.tolist() == np.cumsum([0] + [len(x) for x in want])[:-1].tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(x.tobytes()) for x in want]
    three = token_files.read_token_files(spark, path, [0, 5, 10**9]).collect()
    assert sorted(r["doc_id"] for r in three) == [0, 5] and all(r["ids"] == want[r["doc_id"]].tolist() for r in three)


def test_packing(docs, local, bpe):
    found = packing.pack(docs, WORD_BPE, size=512).toPandas()
    ids = {i: np.append(x, 1).astype("<u4") for i, x in zip(local.doc_id, bpe.encode(list(local.text)))}
    assert found.length.sum() == sum(map(len, ids.values()))
    for r in found.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for key, at in (("doc_id", "start"), ("sequence_id", "offset")):
        for _, g in found.groupby(key):
            g = g.sort_values(at)
            assert g[at].tolist() == np.cumsum([0, *g.length])[:-1].tolist()
    assert found.groupby("sequence_id").length.sum().max() <= 512
    assert 1 - found.length.sum() / found.sequence_id.nunique() / 512 < 0.05


def test_pack_histogram():
    for counts in ({3: 5, 4: 1}, {10: 3}, {1: 100}, {7: 2, 3: 2, 10: 1}):
        patterns = packing.pack_histogram(counts, 10)
        used = collections.Counter()
        for uses, pattern in patterns:
            assert sum(pattern) <= 10 and uses > 0
            for n in pattern:
                used[n] += uses
        assert dict(used) == counts


# 4 counts


def test_rollup(spark, sf, tmp_path):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    keys = [*rollup.KEYS, "n_docs", "n_tokens"]
    got = sorted(tuple(r[k] for k in keys) for r in rollup.rollup_words(spark, sf).collect())
    assert got == sorted(con.execute(f"select {', '.join(keys)} from ({rollup.WORDS_SQL})").fetchall())

    r = rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert r.totals().collect() == []
    rows = spark.createDataFrame([("s", None, "v", 5, 1), ("s", None, "v", None, 1), (None, "en", "v", 7, 1)], "source string, lang string, tokenizer_version string, n_tokens long, sign int")
    r.commit(1, rows)
    r.commit(2, rows.where("source = 's'").withColumn("sign", -F.col("sign")))
    r.commit(2, rows.where("source = 's'").withColumn("sign", -F.col("sign")))
    r.commit(3, rows.limit(0))
    want = [(None, "en", "v", 1, 7)]
    assert [tuple(x) for x in r.totals().collect()] == want
    r.compact()
    r.commit(1, rows)
    assert [tuple(x) for x in r.totals().collect()] == want
    r.commit(9, rows)
    r.compact()
    assert sum(x["n_docs"] for x in r.totals().collect()) == 4


def test_token_counts_by_library(spark, sf):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    toxic = set(labels.doc_id[labels.toxic == 1])
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    kept = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    for d in kept[~kept.doc_id.isin(toxic)].itertuples():
        text = d.text if isinstance(d.text, str) else ""
        counts = len(words.encode(text, add_special_tokens=False).ids) + 1, len(pieces.encode(text))
        for version, n in zip(("word_bpe_49k", "piece_bpe_32k"), counts):
            docs, tokens = want.get((d.source, d.lang, version), (0, 0))
            want[d.source, d.lang, version] = docs + 1, tokens + n
    got = {tuple(r[k] for k in rollup.KEYS): (r["n_docs"], r["n_tokens"]) for r in rollup.op4_token_counts(spark, sf).collect()}
    assert got == want and len({source for source, _, _ in want}) > 1


def test_token_counts_of_hard_rows(spark):
    import public_tokenizers

    paths = [public_tokenizers.path(f) for f in ("word_bpe_49k.json", "piece_bpe_32k.model")]
    rows = [(1, None, None, None), (None, "s", "en", ""), (2, "s", "en", "word " * 200_000), (2, "s", "en", "a b"), (2, "s", "en", "a b")]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, source string, lang string, text string, n_word string")
    got = sorted(tuple(r) for r in rollup.tokenizer_counts(docs, *paths).select("n_word", "n_piece").collect())
    assert got[:2] == [(0, 0), (0, 0)] and got[2] == got[3] and got[4][0] == 200_000
    assert rollup.tokenizer_counts(docs.limit(0), *paths).count() == 0


def test_compact_that_breaks_off_loses_nothing(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("s", "en", "v", 5, 1)], "source string, lang string, tokenizer_version string, n_tokens long, sign int")
    r = rollup.TokenRollup(spark, str(tmp_path / "r"))
    r.commit(7, rows)
    r.compact()
    r.commit(3, rows)  # an id below those of the base
    want = [("s", "en", "v", 2, 10)]
    assert [tuple(x) for x in r.totals().collect()] == want
    real = rollup.TokenRollup._sum

    def fails(self, folders):
        real(self, folders).collect()
        raise RuntimeError("lost")

    monkeypatch.setattr(rollup.TokenRollup, "_sum", fails)
    with pytest.raises(RuntimeError):
        r.compact()
    monkeypatch.setattr(rollup.TokenRollup, "_sum", real)
    assert [tuple(x) for x in r.totals().collect()] == want
    for _ in range(2):
        r.compact()
        r.commit(3, rows)
        assert [tuple(x) for x in r.totals().collect()] == want


# 5 lines


def _components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(rows):
    """Dropped lines of (doc_id, text) rows, by comparing all pairs of lines."""
    import xxhash

    lines = {}
    for i, text in sorted(rows):
        for no, line in enumerate((text or "").split("\n")):
            norm = " ".join(re.findall(r"[^\W_]+", line.lower()))
            if norm.count(" ") >= 2:
                lines.setdefault(norm, []).append((i, no))
    names = list(lines)

    def fp(norm):
        words = norm.split(" ")
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(words))

    fps = np.array([fp(n) for n in names], np.uint64)
    links = []
    for k in range(len(names)):
        for j in np.flatnonzero(np.bitwise_count(fps[k + 1 :] ^ fps[k]) <= 3):
            a, b = names[k].split(), names[k + 1 + j].split()
            if _levenshtein(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
                links.append((k, k + 1 + int(j)))
    groups = collections.defaultdict(list)
    for k, root in enumerate(_components(len(names), links)):
        groups[root] += lines[names[k]]
    return {o for g in groups.values() for o in sorted(g)[1:]}, len(links)


def near_copies(n):
    """Copies of one line with one word changed, among other lines."""
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(n):
        w = list(words)
        w[i % 60] = f"other{i}"
        rows.append((i, "A line of its own, number " + "x" * i + "\n" + " ".join(w) + "\n\nshort one"))
    return rows


def test_lines(spark, docs, local):
    for rows in (list(zip(local.doc_id.tolist(), local.text)), near_copies(80)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        want, links = brute_lines(rows)
        assert links
        found = line_dedup.deduplicate(df).collect()
        got = {(r["doc_id"], int(no)) for r in found for no in (r["_gone"] or [])}
        assert got == want
        texts = dict(rows)
        for r in found:
            kept = [x for no, x in enumerate(texts[r["doc_id"]].split("\n")) if (r["doc_id"], no) not in want]
            assert r["text"] == "\n".join(kept)


def brute_edits(rows):
    """Dropped lines of (doc_id, text) rows, by the edit similarity of all pairs of lines alone."""
    lines = {}
    for i, text in sorted(rows):
        for no, line in enumerate((text or "").split("\n")):
            if norm := " ".join(re.findall(r"[\u3040-\u30ff\u4e00-\u9fff]|[^\W_\u3040-\u30ff\u4e00-\u9fff]+", line.lower())):
                lines.setdefault(norm, []).append((i, no))
    names = [n.split() for n in lines]
    counts = [collections.Counter(n) for n in names]
    links = []
    for k, a in enumerate(names):
        for j in range(k + 1, len(names)):
            b = names[j]
            most = int(max(len(a), len(b)) * 0.2 + 1e-9)
            # words of one line that the other lacks each take an edit
            if abs(len(a) - len(b)) <= most and (counts[k] - counts[j]).total() <= most and _levenshtein(a, b) <= most:
                links.append((k, j))
    groups = collections.defaultdict(list)
    for root, places in zip(_components(len(names), links), lines.values()):
        groups[root] += places
    return {o for g in groups.values() for o in sorted(g)[1:]}


def changed_lines():
    """Lines of 1 to 40 words, also with repeated words, with up to one edit in five words, and lines without spaces."""
    rnd = np.random.default_rng(5)
    rows = []
    for n in [1, 2, 3, 4, 5, 6, 9, 10, 14, 15, 19, 20, 25, 40]:
        for few in (2, 400):
            line = [f"w{x}" for x in rnd.integers(0, few, n)]
            for edits in (0, max(1, n // 5), n // 5 + 1):
                new = list(line)
                for _ in range(edits):
                    at, what = rnd.integers(0, len(new) + 1), rnd.integers(0, 3)
                    new[at : at + (what > 0)] = ["new"] if what < 2 else []
                rows.append(" ".join(new))
    rows += ["短い文章が何度も出てくる", "短い文章が何度も出てきた", "全く別の行", "全く別の行", "Yes.", "yes", ""]
    return [(i, f"{x}\n\nown line {i} {'y' * i}") for i, x in enumerate(rows)]


def test_lines_by_edits(spark, local):
    for rows in (list(zip(local.doc_id.tolist(), local.text)), near_copies(30), changed_lines()):
        want = brute_edits(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        found = line_dedup.deduplicate(df, by_edits=True).collect()
        assert {(r["doc_id"], int(no)) for r in found for no in (r["_gone"] or [])} == want
        texts = dict(rows)
        for r in found:
            assert r["text"] == "\n".join(x for no, x in enumerate(texts[r["doc_id"]].split("\n")) if (r["doc_id"], no) not in want)
    assert {(84 + k, 0) for k in (1, 3, 5)} <= want


def test_line_query_searches_by_edits(spark, tmp_path):
    rows = changed_lines()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["n_dropped"] for r in line_dedup.op5_line_dedup(spark, str(tmp_path)).collect()}
    want = collections.Counter(i for i, _ in brute_edits(rows))
    assert found == {i: want[i] for i, _ in rows}


def test_long_lines_lose_no_link(spark):
    """Twenty of a hundred words differ, the longest ones: the rarest pairs of neighbours are all among the changed ones."""
    short = [np.base_repr(1000 + 7 * k, 36).lower() for k in range(80)]
    line = lambda name: " ".join(w for k in range(20) for w in (f"seldomseen{name}{k}", *short[4 * k : 4 * k + 4]))
    rows = [(1, line("x")), (2, line("y")), (3, line("z") + " more"), (4, " ".join(short[::-1]))]
    found = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), by_edits=True).collect()
    assert {(r["doc_id"], int(no)) for r in found for no in (r["_gone"] or [])} == brute_edits(rows) == {(2, 0)}


def test_line_keys_are_of_rare_pairs(spark):
    """Lines that have pairs of long words of their own share no key, whatever shorter words they have in common."""
    rnd = np.random.default_rng(8)
    rows = [(i, " ".join([f"often{w}" for w in rnd.integers(0, 9, 25)] + [f"seldomseen{i}x{k}" for k in range(9)])) for i in range(200)]
    lines = line_dedup.edit_lines(spark.createDataFrame(rows, "doc_id long, text string"), 0.8, 7)
    keys = [k for r in lines.collect() for k in r["keys"]]
    assert len(keys) == len(set(keys)) == 7 * 200


def test_line_keys_are_shuffled_once(spark, monkeypatch):
    plans, write = {}, line_dedup.materialise

    def seen(df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, tag)

    monkeypatch.setattr(line_dedup, "materialise", seen)
    rows = near_copies(30)
    line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), by_edits=True).collect()
    assert "line-buckets" not in plans and plans["line-members"].count("Exchange hashpartitioning") == 1


# 6 quality


def test_quality(docs, local, spark, sf):
    found = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for i, text in zip(local.doc_id, local.text):
        w = word.findall(text)
        lines = [x for x in text.split("\n") if word.search(x)]
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in quality.filter_documents(docs).collect()}
    assert kept == {i for i, r in found.items() if r["kept"]}


def test_repeated_words_with_many_kinds():
    words = [b"w%d" % (i % 9000) for i in range(9500)]
    assert quality.repeated_words(words) == 1000


def test_mcd_is_the_plain_one(spark):
    """Distances against a numpy version of the same steps, with outliers far from the cloud."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        words = [("w" * rng.integers(2, 9)) + str(j) for j in range(int(rng.lognormal(4, 0.6)) + 12)]
        text = " ".join(words)
        rows.append((i, text + " ### $$$" * 40 if i < 20 else text, "en", "s", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    stats = np.array([quality.text_stats(r[1]) for r in rows])
    ok = np.array([s[0] >= 10 and 100 * s[4] <= 20 * s[0] for s in stats])
    x = quality._vector(stats[ok])
    m = np.array([np.median(np.round(c / 16)) * 16 for c in x.T])
    s = np.array([np.median(np.round(np.abs(c - k) / 16)) * 16 for c, k in zip(x.T, m)])
    inv = np.diag(1 / ((s * 1.4826) ** 2 + (np.array(quality.FLOORS) * quality.UNIT) ** 2))
    for _ in range(5):
        d2 = np.einsum("ni,ij,nj->n", x - m, inv, x - m)
        bins = np.floor(np.log2(1 + d2) * 16)
        limit = np.sort(bins)[int(np.ceil(0.75 * len(bins))) - 1]
        part = x[bins <= limit].astype(float)
        share = min(1.0, len(part) / len(x))
        m = part.mean(axis=0)
        cov = np.cov(part.T, bias=True)
        if share < 1:
            cov *= share / quality._chi2_cdf(quality.chi2_quantile(share), quality.DIM + 2)
        inv = np.linalg.inv(cov + np.diag((np.array(quality.FLOORS) * quality.UNIT) ** 2))
    d2 = np.einsum("ni,ij,nj->n", x - m, inv, x - m)
    want = {i: bool(v) for i, v in zip(np.flatnonzero(ok).tolist(), d2 <= quality.cutoff_of(1e-6))}
    assert {i: kept[i] for i in want} == want
    assert not any(kept[i] for i in range(20)) and np.mean([kept[i] for i in range(20, 400)]) > 0.99


# 7 personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if _passes(k, m.group()))


def test_base_spans(spark, docs, local):
    texts = ["a@b.c%d@e.f x.y@z", "a.b@c.d@e.f.g", "1.2.3.4.5.6.7.8 999.1.1.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111222 5 4111 1111 1111 1111",
             "é+1 (234) 555-1234 +1((((( +12 +1234567890123456", "x" * 20000 + "@", "1" * 5000, None, "", "4111111111111111@x.y +4111111111111111", "++1 234 5678-", "a@b a@b.c. @x.y a@-.-", "語 a@b.co", "1  4111111111111111 00255.1.1.01"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find(df).collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    for i, t in zip(local.doc_id, local.text):
        want = brute_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[i]["spans"].startswith(want)
        assert got[i]["n_email"] == want.count("email:")


def test_disclosure(spark):
    rows = [(i, f"note {w} {w}x from zorblat mail zed@x.org then {w}{i} end") for i, w in enumerate(["alpha", "beta", "gamma", "delta", "eps"])]
    rows += [(10 + i, f"plain text number {w} then end of note from mail") for i, w in enumerate("pqrs")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # n(t, e) = n(t) = n(e): the term gives the value away completely
    terms = {(r["term"], r["action"]) for r in pii.disclosing_terms(df, pii.scanned(df)).collect()}
    assert terms == {("zorblat", "remove")}
    found = {r["doc_id"]: r["spans"] for r in pii.find(df).collect()}
    start = rows[0][1].index("zorblat")
    assert f"term:{start}:{start + 7}" in found[0] and found[10] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[0] == "note alpha alphax from  mail [EMAIL] then alpha0 end" and clean[10] == rows[5][1]
    copies = spark.createDataFrame([(i, "one note from zorblat mail zed@x.org and so on" + " x" * i) for i in range(6)], "doc_id long, text string")
    assert pii.disclosing_terms(copies, pii.scanned(copies)).count() == 0  # near copies have one context


def brute_disclosure(texts, context=120, support=3, generalise_at=0.75, remove_at=0.9):
    """(entity, term, action) of (doc_id, text) rows with e-mail addresses only, by the definition; no copies among the texts."""
    near, contexts, holders = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(set)
    term = re.compile(r"[^\W_]+")
    for i, t in texts:
        for m in re.finditer(PLAIN["email"], t):
            first, last = (0, len(t)) if context is None else (max(0, m.start() - context), m.end() + context)
            around = t[first : m.start()] + "\n" + t[m.end() : last]
            for e in ("email:" + m.group().lower(), "email of @" + m.group().lower().split("@")[1]):
                holders[e].add(i)
                for w in set(term.findall(around.lower())):
                    if len(w) >= 2:
                        near[e, w].add(i)
                        contexts[e, w].add(around)
    words = {i: set(term.findall(t.lower())) for i, t in texts}
    found = set()
    for (e, w), docs in near.items():
        n_c, n_te, n_e, n = len(contexts[e, w]), len(docs), len(holders[e]), len(texts)
        if n_c >= support and 2 * n_c >= n_te and n > n_e:
            n_t = sum(w in x for x in words.values())
            ratio = np.log(n_te * n / (n_t * n_e)) / np.log(n / n_e)
            if ratio >= generalise_at - 1e-9:
                found.add((e, w, "remove" if ratio >= remove_at - 1e-9 else "generalise"))
    return found


def test_disclosure_by_definition(spark):
    """Planted names and numbers near addresses of three domains, against the definition."""
    rnd = np.random.default_rng(9)
    word = lambda: f"w{rnd.integers(0, 150)}"
    rows = []
    for i in range(160):
        words = [word() for _ in range(12)]
        if i < 40:
            k = i % 4
            words[6:6] = [f"Name{k}", f"p{i}@{'abc'[k % 3]}.org", str(4000 + k % 3)]
        elif i < 50:
            words[3] = f"Name{i % 4}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["entity"], r["term"], r["action"]) for r in pii.disclosing_terms(df, pii.scanned(df)).collect()}
    want = brute_disclosure(rows)
    assert got == want and {a for _, _, a in want} == {"remove", "generalise"}
    whole = {(r["entity"], r["term"], r["action"]) for r in pii.disclosing_terms(df, pii.scanned(df, None)).collect()}
    assert whole == brute_disclosure(rows, context=None)
    far = [(i, f"p{i}@far.org " * (i < 12) + " ".join(word() for _ in range(60)) + f" hidden{i % 2}" * (i < 12)) for i in range(40)]
    distant = spark.createDataFrame(far, "doc_id long, text string")
    terms = lambda context: {r["term"] for r in pii.disclosing_terms(distant, pii.scanned(distant, context), generalise_at=0.4).collect()}
    assert "hidden0" in terms(None) and "hidden0" not in terms(120)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert not any("4000" in clean[i] for i in range(40)) and any("[CODE]" in clean[i] for i in range(40))
    assert all(clean[i] == t for i, t in rows[50:])


# 8 SimHash


def test_keep_one_by_row(spark):
    a, b = "one text of some words here", "quite another text with no word in common at all"
    rows = [(2, a), (5, a), (5, b), (5, b), (None, a), (None, b), (7, "a third one that is all alone"), (7, "a third one that is all alone")]
    kept = sorted(tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [(2, a), (5, b), rows[6]]


@pytest.mark.parametrize("tile", [8192, 16])
def test_simhash(spark, docs, local, tile):
    rows = [*zip(local.doc_id.tolist(), local.text), *[(10**6 + i, t) for i, t in near_copies(120)], (10**7, ""), (10**7 + 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = np.array([simhash.fingerprint(t) for _, t in rows], np.uint64)
    links = [(k, k + 1 + int(j)) for k in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(fps[k + 1 :] ^ fps[k]) <= 3)]
    roots = _components(len(rows), links)
    first = {}
    for (i, _), r in zip(rows, roots):
        first[r] = min(i, first.get(r, i))
    found = {r["doc_id"]: r for r in simhash.near_duplicates(df, tile=tile).collect()}
    for (i, _), r, f in zip(rows, roots, fps):
        assert found[i]["component_id"] == first[r] and int(found[i]["fingerprint"], 16) == int(f)


def test_fingerprint_by_definition():
    import xxhash

    text = "One two\tTHREE four É"
    words = ["one", "two", "three", "four", "É"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(3)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert simhash.fingerprint("Two words") == xxhash.xxh64_intdigest(b"two words", 42) and simhash.fingerprint("") == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_planes(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 1, np.uint64)[0]
    fps = np.array([base ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 8)))) for _ in range(300)], np.uint64)
    planes = simhash.BitPlanes(fps)
    for k in (0, 7, 299):
        near = planes.near(int(fps[k]), radius)
        assert [near >> j & 1 for j in range(300)] == (np.bitwise_count(fps ^ fps[k]) <= radius).astype(int).tolist()


# 9 pieces


def _library_spans(library, text):
    return [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


TRICKY = ["", " ", "  a  b ", "hello\nworld\t x", "日本語のテキスト ab", "▁▁x ▁", "é" * 300, "x" * 1000, "=" * 5000, "a b" * 500, "\x00\x01", "ŀ ﬁ Å ½ Ａｂｃ １２", "emoji 😀😀 ok", "ＡＢＣ　ｄ", " 　 x  y  "]


def test_pieces(local):
    from sentencepiece import SentencePieceNormalizer, sentencepiece_model_pb2

    content = open(PIECE_BPE, "rb").read()
    models = [content]
    for squeeze in (False, True):
        model = sentencepiece_model_pb2.ModelProto.FromString(content)
        other = sentencepiece_model_pb2.ModelProto.FromString(SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
        model.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
        model.normalizer_spec.remove_extra_whitespaces = squeeze
        models.append(model.SerializeToString())
    for content in models:
        own = pieces.PieceBpe(content)
        texts = TRICKY + local.text[:40].tolist()
        for text, x in zip(texts, own.encode(texts)):
            assert list(zip(x.ids.tolist(), x.begin.tolist(), x.end.tolist())) == _library_spans(own.library, text)


def test_round_trip(docs, local):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PIECE_BPE)
    found = {r["doc_id"]: r for r in pieces.round_trip(docs, PIECE_BPE).collect()}
    for i, text in zip(local.doc_id, local.text):
        ids = library.encode(text, add_eos=True)
        assert found[i]["n_tokens"] == len(ids) and found[i]["spanned_bytes"] == len(text.encode())
        assert found[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# 10 media


def test_media(docs, local):
    media = mpeg_audio.to_media(docs)
    found = {r["doc_id"]: r for r in mpeg_audio.digest_media(media).collect()}
    for i, text in zip(local.doc_id, local.text):
        payload, n = mpeg_audio.padded(text)
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (n, len(payload)) and len(payload) % 64 == 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        data = mpeg_audio.write_stream(payload, n)
        assert r["media_bytes"] == len(data) and r["media_sha256"] == hashlib.sha256(data).hexdigest()
    index = mpeg_audio.index_media(media.limit(3)).collect()
    assert all(r["duration"] == r["n_frames"] * 1152 / 48000 and len(r["frame_offsets"]) == r["n_frames"] == r["table_frames"] for r in index)


def test_duration_of_changing_rates():
    header = lambda rate: bytes([0xFF, 0xFB, 0x90 | rate << 2, 0x00])
    frames = lambda rate, n: (header(rate).ljust(mpeg_audio.parse_header(header(rate)).length, b"\0")) * n
    stream = mpeg_audio.read_stream(frames(0, 100) + frames(1, 100))
    assert len(stream.offsets) == 200 and stream.duration == pytest.approx(100 * 1152 / 44100 + 100 * 1152 / 48000, abs=1e-12)
    assert mpeg_audio.read_stream(b"").duration == 0.0


def test_damaged_streams():
    payload, n = mpeg_audio.padded("text " * 2000)
    data = mpeg_audio.write_stream(payload, n)
    good = mpeg_audio.read_stream(data)
    assert good.payload == payload and good.crc_bad == good.skipped == 0
    noise = mpeg_audio.read_stream(b"junk\xff\xfb\x12" + data)
    assert noise.skipped == 7 and noise.payload == payload
    at = good.offsets[1]
    broken = mpeg_audio.read_stream(data[:at] + b"\xff\xff\xffgarbage" + data[at:])
    assert broken.skipped == 10 and len(broken.offsets) == len(good.offsets)
    flipped = bytearray(data)
    flipped[at + 4] ^= 1
    assert mpeg_audio.read_stream(bytes(flipped)).crc_bad == 1
    tagged = mpeg_audio.read_stream(data + b"TAG" + b"a title".ljust(125, b"\0"))
    assert tagged.tags["title"] == "a title" and tagged.payload == payload
    assert mpeg_audio.read_stream(b"").offsets == [] and mpeg_audio.read_stream(b"no audio at all").samples == 0
    # headers of other versions and layers: bytes, samples and sampling rate as the format defines them
    for four, want in ((b"\xff\xfb\x90\x00", (417, 1152, 44100)), (b"\xff\xfd\x90\x00", (522, 1152, 44100)), (b"\xff\xff\x90\x00", (312, 384, 44100)), (b"\xff\xf3\x90\x00", (261, 576, 22050))):
        head = mpeg_audio.parse_header(four)
        assert (head.length, head.samples, head.rate) == want
    assert mpeg_audio.parse_header(b"\xff\xfb\xf0\x00") is None


def _bits(text):
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big") if text else b""


def _slow_crc(bits):
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 ^ (0x8005 if crc >> 15 ^ int(b) else 0)) & 0xFFFF
    return crc


@pytest.mark.parametrize(
    "head, allocation, selection",
    [
        (b"\xff\xfe\x94\x00", "01" * 128, ""),  # layer I, stereo: 64 allocations of 4 bits
        (b"\xff\xfe\x94\xc0", "1001" * 32, ""),  # mono
        (b"\xff\xfe\x94\x50", "0001" * (16 + 24), ""),  # joint stereo, one allocation for both from subband 8 on
        (b"\xff\xfc\xa4\x00", "0001" * 22 + "000" * 24 + "01" * 8, "10" * 30),  # layer II, 192 kbit/s at 48 kHz: 27 subbands
        (b"\xff\xfc\xa0\x00", "0000" * 22 + "001" * 24 + "00" * 14, "11" * 24),  # at 44.1 kHz: 30 subbands
        (b"\xff\xfc\x24\xc0", "0010" * 2 + "100" * 6, "01" * 8),  # 48 kbit/s, mono: 8 subbands
        (b"\xff\xfc\x28\xc0", "0010" * 2 + "100" * 10, "01" * 12),  # at 32 kHz: 12
        (b"\xff\xf4\x80\xc0", "0010" * 4 + "000" * 7 + "10" * 19, "01" * 23),  # version 2
        (b"\xff\xfc\xa4\x40", "0001" * (8 + 7) + "001" * 12 + "00" * 4, "10" * (8 + 14 + 24)),  # joint stereo from subband 4 on
    ],
)
def test_checksums_of_layers(head, allocation, selection):
    header = mpeg_audio.parse_header(head)
    covered = allocation + selection
    sums = _slow_crc("".join(f"{b:08b}" for b in head[2:]) + covered)
    frame = (head + sums.to_bytes(2, "big") + _bits(covered)).ljust(header.length, b"\x55")
    assert mpeg_audio.protected_bits(frame, header) == len(covered)
    got = mpeg_audio.read_stream(frame * 3)
    assert (got.crc_ok, got.crc_bad, len(got.offsets)) == (3, 0, 3)
    broken = bytearray(frame * 3)
    broken[header.length + 6] ^= 0x10
    got = mpeg_audio.read_stream(bytes(broken))
    assert (got.crc_ok, got.crc_bad) == (2, 1)


def test_tags_and_tables():
    payload, n = mpeg_audio.padded("word " * 1000)
    data = mpeg_audio.write_stream(payload, n)
    audio = data[data.index(b"\xff\xfa") :]
    seven = lambda k: bytes(k >> s & 127 for s in (21, 14, 7, 0))

    def tags(version, flags, body, after=b""):
        got = mpeg_audio.read_stream(b"ID3" + bytes([version, 0, flags]) + seven(len(body)) + body + after + audio)
        assert got.skipped == 0 and got.payload[: len(payload)] == payload
        return got.tags

    v3 = lambda name, text: name + len(text).to_bytes(4, "big") + b"\0\0" + text
    assert tags(3, 0x40, (6).to_bytes(4, "big") + bytes(6) + v3(b"TIT2", b"\0abc")) == {"TIT2": "abc"}  # extended header
    latin = v3(b"TIT2", b"\0a\xff\xe0b") + bytes(20)
    assert tags(3, 0x80, latin.replace(b"\xff", b"\xff\0")) == {"TIT2": "a\xff\xe0b"}  # unsynchronised
    assert tags(3, 0, v3(b"TPE1", b"\1" + "é\u4e2d".encode("utf-16"))) == {"TPE1": "é\u4e2d"}
    assert tags(3, 0, v3(b"TXXX", b"\1" + "k\0".encode("utf-16") + "v".encode("utf-16"))) == {"k": "v"}
    assert tags(3, 0, b"TIT2" + (4).to_bytes(4, "big") + b"\0\x80" + b"\0abc" + v3(b"TPE1", b"\0x")) == {"TPE1": "x"}  # compressed
    v4 = lambda name, text, form=0: name + seven(len(text)) + bytes([0, form]) + text
    assert tags(4, 0x50, seven(6) + b"\1\0" + v4(b"TIT2", b"\3" + "é".encode()), b"3DI\4\0\x50" + seven(0)) == {"TIT2": "é"}  # footer
    assert tags(4, 0, v4(b"TIT2", seven(4) + b"\0a\xff\0\xe0", 3) + v4(b"TPE1", b"\0y")) == {"TIT2": "a\xff\xe0", "TPE1": "y"}
    assert tags(2, 0, b"TT2\0\0\4\0abcTXX\0\0\4\0k\0v") == {"TT2": "abc", "k": "v"}
    assert tags(3, 0, b"TIT2\x7f\xff\xff\xff\0\0\0cut") == {"TIT2": "cut"} and tags(3, 0, b"") == {}
    # a table of three entries, two frames each
    size = len(mpeg_audio.FRAME_HEADS[9]) + mpeg_audio.ROOM[9]
    first = (b"\xff\xfb" + mpeg_audio.FRAME_HEADS[9][2:4] + bytes(32) + b"VBRI" + bytes(6) + (5000).to_bytes(4, "big") + (6).to_bytes(4, "big") + b"".join(k.to_bytes(2, "big") for k in (3, 10, 2, 2, 100, 110, 120))).ljust(size, b"\0")
    got = mpeg_audio.read_stream(first + audio[len(first) :])
    assert (got.table_frames, got.table_bytes, got.seek_points) == (6, 5000, [0, 1000, 2100])
    whole = mpeg_audio.read_stream(data)
    assert len(whole.seek_points) == 100 and all(0 <= a <= b < whole.table_bytes for a, b in zip(whole.seek_points, whole.seek_points[1:]))


# the pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline
    from waylake.llm.common import materialise

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, materialise(stage(spark, docs, sf), "test")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
            assert docs.where("n_chars != length(text)").isEmpty()
            assert {r[0] for r in docs.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] == counts[3]
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = materialise(stage(spark, empty, sf), "test")
    assert empty.count() == 0


def test_registry():
    assert [int(k[2:].split("_")[0]) for k in registry.QUERIES if k.startswith("op")] == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)

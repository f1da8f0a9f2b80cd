"""Training-data operators against brute force, and on odd tables: nulls in
any column, empty and very long texts, ties, repeated rows, empty tables and
extra columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agentrail.llm import (chat_format, fingerprints, jaccard_join, language_id, line_dedup, mixing, packing,
                           quality_rules, token_files, tokens, toxicity)
from agentrail.llm.common import word_count

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, h string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"shared{i}" for i in range(60))
LONG = " ".join(f"w{i % 4999} x{i % 17}" for i in range(30_000))


def odd_rows():
    rng = random.Random(5)
    plain = [" ".join(rng.choice("the of and to ab cd ef gh ij".split()) + str(rng.randint(0, 400)) for _ in range(90)) for _ in range(12)]
    near = plain[0].split()
    near[40] = "changed"
    texts = plain + [None, "", " \n\t ", LONG, plain[1] + "\n" + PASSAGE, "head\n" + PASSAGE + "\nend", PASSAGE, PASSAGE,
                     " ".join(near), "one", "two words", "é ü 漢字", "A  B\r\n\x0bC", "a\n\nb", "the " * 80]
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "b", "a", "é"][i % 4], None, -1, 0.5, "x") for i, t in enumerate(texts)]
    return rows + [rows[2], rows[2], (None, plain[3], None, None, 1, 2, None, None), (7, "same key, other text", "en", "a", 1, 2, 0.1, "h")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORDS.findall(t or "")


def shingles(t, n=3):
    w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def test_quality_measures_equal_brute_force(odd, none):
    got = quality_rules.judge(odd)
    assert got.columns.count("n_words") == 1 and "lang" in got.columns
    want = Counter()
    for r in odd_rows():
        ws, lines = words(r[1]), [x for x in (r[1] or "").split("\n") if WORDS.search(x)]
        wins = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
        n = Counter(wins)
        rep = len({i + k for i, w in enumerate(wins) if n[w] > 1 for k in range(3)})
        want[(r[0], len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", r[1] or "")), len(lines) - len(set(lines)), rep,
              len(ws) < 50 or 100 * rep > 50 * len(ws))] += 1
    rows = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert Counter(map(tuple, rows)) == want
    assert quality_rules.judge(none).count() == 0
    assert [r.kept for r in got.where("base_failed").select("kept").distinct().collect()] == [False]


def brute_lines(rows, least=50):
    docs = sorted({(r[0] is not None, r[0], r[1]) for r in rows if r[1] is not None}, key=lambda d: (d[0], d[1] or 0))
    lines = [(d, i, x) for d in docs for i, x in enumerate(d[2].split("\n"))]
    gone = Counter()
    for p in range(len(lines)):
        best = 0
        for q in range(p):
            k = 0
            while (p + k < len(lines) and q + k < len(lines) and lines[p + k][0] == lines[p][0] and lines[q + k][0] == lines[q][0]
                   and lines[p + k][2] == lines[q + k][2]):
                k += 1
            if sum(len(words(x[2])) for x in lines[p:p + k]) >= least:
                best = max(best, k)
        for k in range(best):
            gone[lines[p + k][:2]] = 1
    return {d[1:]: "\n".join(x for i, x in enumerate(d[2].split("\n")) if not gone[(d, i)]) for d in docs}


def test_line_dedup_equals_brute_force(spark, odd, none):
    rng = random.Random(2)
    some = [" ".join(f"l{j}w{k}" for k in range(rng.choice([0, 3, 20, 30, 70]))) for j in range(9)]
    rows = [(i, "\n".join(rng.choice(some) for _ in range(rng.randint(1, 14)))) for i in range(25)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_lines(rows)
    assert {r.doc_id: r.text for r in got.collect()} == {i: want[(i, t)] for i, t in rows}
    rows = [r for r in odd_rows() if r[0] != 7]
    got = {(r.doc_id, r.lang, r.source): r.text for r in line_dedup.dedup_lines(odd.where("doc_id is null or doc_id <> 7")).collect()}
    want = brute_lines(rows)
    assert got == {(r[0], r[2], r[3]): (None if r[1] is None else want[(r[0], r[1])]) for r in rows}
    assert line_dedup.dedup_lines(odd).count() == odd.count()
    assert line_dedup.dedup_lines(none).count() == 0


def test_packing_is_whole_gapless_and_right(odd, none):
    got = packing.pack(odd, tokens.vocabulary(), most=64).collect()
    enc = tokens.encoder(tokens.vocabulary())
    ids = Counter()
    for r in odd_rows():
        raw = enc.encode([r[1] or ""])[0] + b"\0\0\0\0"
        at = packing.cut_points(len(raw) // 4, 64)
        for j, (a, b) in enumerate(zip(at, at[1:] + [len(raw) // 4])):
            ids[(r[0], j, a, b - a, zlib.crc32(raw[4 * a:4 * b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == ids
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(seqs) <= -(-total // 64) + 2
    assert packing.pack(none, tokens.vocabulary()).count() == 0


def test_encoder_equals_the_library():
    rng = random.Random(1)
    alphabet = list(" \t\n\r\x0b\x0c\x1c\x85\xa0  ab'sl9é漢.!") + ["<|endoftext|>", "\0", "word", " the", "'ll"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    enc, library = tokens.encoder(tokens.vocabulary()), Tokenizer.from_file(tokens.vocabulary())
    for t, raw in zip(texts, enc.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_jaccard_components_equal_brute_force(spark, odd, none):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([1, 2, 5, 30, 200]))] for _ in range(12)]
    rows = []
    for i in range(400):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            b[rng.randrange(len(b))] = f"e{rng.randint(0, 30)}"
        rows.append((i, " ".join(b).upper() if i % 5 == 0 else "  ".join(b)))
    rows += [(1000, None), (1001, " ")]
    sets = {i: frozenset(tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))) if (w := words((t or "").lower())) else frozenset()
            for i, t in rows}
    for percent in (90, 80):
        root = {i: i for i in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
        got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
        assert {r.doc_id: (r.n_shingles, r.rep.key) for r in got} == {i: (len(sets[i]), find(i)) for i in sets}
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert kept.where("doc_id in (17, 18, 19)").count() == 1 and kept.where("doc_id = 2").count() == 1
    assert jaccard_join.similar_components(none).count() == 0 and jaccard_join.one_of_each(none).count() == 0


def test_jaccard_blocks_find_what_the_pivot_does_not(spark, monkeypatch):
    """Chains of near copies, many more than a group holds."""
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    chain = [[f"c{i}" for i in range(k, k + 120)] for k in range(0, 120, 4)]
    rows = [(i, " ".join(c)) for i, c in enumerate(chain)]
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.rep.key for r in got} == {0}


@pytest.mark.parametrize("side, copies", [(1 << 20, 30), (1000, 210)])
def test_jaccard_blocks_copy_a_class_once_a_row_and_column(spark, monkeypatch, side, copies):
    """30 classes of 118 shingles: one block, or 4 rows and at most 4 columns."""
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    monkeypatch.setattr(jaccard_join, "SIDE_TOKENS", side, raising=False)
    block, read = jaccard_join._block, spark.sparkContext.accumulator(0)

    def counted(percent):
        def one(df):
            read.add(len(df))
            return block(percent)(df)
        return one

    monkeypatch.setattr(jaccard_join, "_block", counted)
    rows = [(k, " ".join(f"c{i}" for i in range(4 * k, 4 * k + 120))) for k in range(30)]
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.rep.key for r in got} == {0} and 0 < read.value <= copies


def test_one_of_each_keeps_its_scratch_small(spark, odd):
    """Tables of signatures, shingles and pairs go when they are read; shuffle
    files go with their query, and of texts only some are shuffled."""
    base = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda: {f.getPath().getName() for f in fs.listStatus(base)}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = there(), spark.conf.get(setting)
    kept = jaccard_join.one_of_each(odd)
    left = {x.rpartition("-")[0] for x in there() - before}
    assert left <= {"jaccard-sets", "jaccard-clusters", "jaccard-links", "jaccard-odd"}
    assert spark.conf.get(setting) == was
    own = {(r[0], r[1]): shingles(r[1]) for r in odd_rows()}
    group = {x: x for x in own if own[x]}
    for x in group:
        for y in group:
            if 100 * len(own[x] & own[y]) >= 90 * len(own[x] | own[y]):
                old, new = group[x], group[y]
                group = {z: new if g == old else g for z, g in group.items()}
    first = lambda g: min((x for x in group if group[x] == g), key=lambda x: (x[0] is not None, x[0]))
    want = Counter(first(g) for g in set(group.values())) + Counter((r[0], r[1]) for r in odd_rows() if not own[r[0], r[1]])
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want


def test_mixing_meets_targets_and_caps(spark, odd, none):
    got = mixing.mix(odd, block=1).collect()
    assert len(got) == odd.count() and all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(odd, block=1).collect()), key=repr)
    rng = random.Random(1)
    rows = [(i, rng.choice("aaaaaab") + "x", " ".join(["w"] * rng.randint(0, 300))) for i in range(600)]
    rows += [(1000 + i, "tiny", "w " * 20) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, shard_words=5000).withColumn("source", F.lit("")).collect()
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(t.split())
    total, caps, left = sum(sizes.values()), {}, dict(zip(sorted(sizes), [1, 2, 3]))
    while True:  # plain filling: cap whoever is above, share out the rest again
        rate = (total - sum(caps.values())) / sum(left.values())
        over = [s for s, w in left.items() if rate * w > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            caps[s] = 3 * sizes[s]
            del left[s]
    want = {**caps, **{s: rate * w for s, w in left.items()}}
    assert {n: pytest.approx(want[s]) for s, n in sizes.items()} == {n: t for n, t in by}
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= max(0.01 * target, 3 * mixing.BLOCK_WORDS)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.select(F.sum(word_count(F.col("text")))).first()[0] == sum(r.taken for r in mixing.mix(df).collect())
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_apportionment_equals_highest_quotients(spark):
    rng = random.Random(8)
    for _ in range(4):
        votes = [rng.choice([0, 1, 5, rng.randint(1, 1000)]) for _ in range(12)]
        seats = rng.randint(0, 60)
        df = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "i long, v long, seats long")
        got = {r.i: r.won for r in mixing.apportion(df, [], ["i"], "v", "seats", "won").collect()}
        q = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(seats)))[:seats]
        won = Counter(i for _, i in q)
        assert sum(got.values()) == (seats if any(votes) else 0)
        last = -q[-1][0] if q else 0
        for i, v in enumerate(votes):  # equal up to ties at the last quotient
            if got[i] != won[i]:
                assert any(abs(v / (2 * k + 1) - last) < 1e-9 for k in range(seats))


def test_chat_round_trip(spark):
    rng = random.Random(3)
    bits = ["[", "]", "<", ">", "\\", "/", "s", "INST", "</s>", "<s>", "[INST]", "[/INST]", "[\\INST]", " ", "\n", "é", "漢"]
    convs = {c: [(rng.choice(["user", "assistant", "system", "a\\nb", "x\ny", None]),
                  rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 20)))]))
                 for _ in range(rng.randint(1, 6))] for c in range(60)}
    rows = [(c, i, r, t, 1) for c, ts in convs.items() for i, (r, t) in enumerate(ts)]
    rows += [(99, None, "user", "null turn", 1), (99, 1, "assistant", "x", 1), (99, 1, "assistant", "x", 1), (None, 0, "user", "q", 1)]
    convs[99] = [("user", "null turn"), ("assistant", "x"), ("assistant", "x")]
    convs[None] = [("user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = chat_format.format_conversations(df, tokens.vocabulary())
    got = {r.conv_id: r for r in chat_format.read_back(out, tokens.vocabulary()).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, ts in convs.items():
        said = "".join(t or "" for r, t in ts if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(ts), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in ts)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), sha(said))
    assert chat_format.format_conversations(df.limit(0), tokens.vocabulary()).count() == 0


def test_token_files_round_trip(spark, odd, none, tmpdir_fresh):
    token_files.write_tokens(odd, f"{tmpdir_fresh}/t", tokens.vocabulary(), meta=["lang", "source"])
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    enc = tokens.encoder(tokens.vocabulary())
    got = token_files.token_index(spark, f"{tmpdir_fresh}/t").orderBy("start").collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = Counter((r[0], zlib.crc32(enc.encode([r[1] or ""])[0] + b"\x02\0\0\0")) for r in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    few = token_files.read_tokens(spark, f"{tmpdir_fresh}/t", ["doc_id", "n_tokens", "lang"], F.col("doc_id") == 3)
    assert few.count() == 1 and "ids" not in few.columns
    token_files.write_tokens(none, f"{tmpdir_fresh}/e", tokens.vocabulary())
    assert token_files.token_index(spark, f"{tmpdir_fresh}/e").count() == 0
    with pytest.raises(ValueError):
        token_files.write_tokens(odd.withColumn("seq", F.lit(1)), f"{tmpdir_fresh}/x", tokens.vocabulary(), meta=["seq"])


def _token_parts(path):
    import glob

    import pyarrow.parquet as pq
    return [pq.ParquetFile(f) for f in sorted(glob.glob(f"{path}/*.parquet"))]


def test_token_files_are_delta_encoded_with_page_indexes(spark, odd, tmpdir_fresh):
    token_files.write_tokens(odd, f"{tmpdir_fresh}/d", tokens.vocabulary(), meta=["lang"])
    seen = 0
    for part in _token_parts(f"{tmpdir_fresh}/d"):
        for g in range(part.metadata.num_row_groups):
            cols = [part.metadata.row_group(g).column(c) for c in range(part.metadata.row_group(g).num_columns)]
            for c in cols:
                if c.path_in_schema.split(".")[0] in ("doc_id", "seq", "n_tokens", "ids") and c.num_values:
                    assert "DELTA_BINARY_PACKED" in c.encodings and not c.has_dictionary_page, c.path_in_schema
                    assert c.has_offset_index and c.has_column_index, c.path_in_schema
                    seen += 1
    assert seen >= 4


def _scanned(df):
    """Rows that the Parquet reader handed over when ``df`` was collected."""
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_selective_reads_open_few_pages(spark, tmpdir_fresh):
    """A reader of one document gets the rows of its pages, by the column
    indexes, and not its row group; a reader of lengths never opens ids."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the and of "), F.col("id").cast("string")).alias("text"))
    token_files.write_tokens(docs, f"{tmpdir_fresh}/p", tokens.vocabulary())
    path = f"{tmpdir_fresh}/p"
    assert max(p.metadata.row_group(0).num_rows for p in _token_parts(path)) > 3 * token_files.PAGE_ROWS
    one = token_files.read_tokens(spark, path, ["doc_id", "ids"], F.col("doc_id") == 12_345)
    assert [r.doc_id for r in one.collect()] == [12_345]
    assert 1 <= _scanned(one) <= token_files.PAGE_ROWS
    lengths = token_files.read_tokens(spark, path, ["doc_id", "n_tokens"])
    assert len(lengths.collect()) == _scanned(lengths) == 30_000
    schema = lengths._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert "n_tokens" in schema and "ids" not in schema


def test_fingerprints_follow_the_order_and_locate_edits(odd, none):
    rows = [r for r in odd_rows() if r[0] is not None and r[0] != 7]
    got = {}
    for r in fingerprints.fingerprints(odd.where("doc_id is not null and doc_id <> 7")).collect():
        got.setdefault(r.doc_id, []).append(r)
    order = sorted(rows, key=lambda r: -r[0])
    for i, r in enumerate(order):
        mine = [g for g in got[r[0]]]
        nexts = {order[(i + 1) % len(order)][1] or "", *( [r[1] or ""] if len(mine) > 1 else [])}
        edits = {hashlib.sha256(fingerprints.edited(r[1] or "", n).encode()).hexdigest() for n in nexts}
        edits |= {hashlib.sha256(fingerprints.edited(r[1] or "", o[1] or "").encode()).hexdigest() for o in order} if len(mine) > 1 else set()
        assert all(g.edited_sha256 in edits and g.n_chars == len(r[1] or "") for g in mine)
        assert {g.fingerprint for g in mine} == {fingerprints.fingerprint(r[1] or "")}
        assert all(0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1 for g in mine)
    assert fingerprints.fingerprints(odd).count() == odd.count()
    assert fingerprints.fingerprints(none).count() == 0
    a = "\n".join(f"line {i} has some words of its own number {i * i}" for i in range(60))
    b = a.replace("line 30 has some", "line 30 had some")
    fa, fb = fingerprints.fingerprint(a), fingerprints.fingerprint(b)
    gone, new = fingerprints.differing(fa, fb)
    assert fa != fb and 1 <= len(gone) <= 3 and 1 <= len(new) <= 3 and 0.95 < fingerprints.likeness(fa, fb) < 1
    assert fingerprints.differing(fa, fa) == ([], []) and fingerprints.likeness(fa, fa) == 1.0


def test_language_profiles_tell_held_out_documents(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.held_out(F.col("doc_id"), 4, 2)
    profiles = language_id.learn(docs.where(~out).select(F.col("doc_id").alias("key"), "text", "lang"))
    got = language_id.predict(docs.where(out), profiles)
    n, right = got.count(), got.where("lang = lang_pred").count()
    assert n > 200 and right / n > 0.97
    odd_got = language_id.predict(odd, profiles).collect()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in odd_got)
    assert all(0 <= r.score <= 1 for r in odd_got)
    assert language_id.learn(none.withColumnRenamed("doc_id", "key")) == {}
    assert {r.lang_pred for r in language_id.predict(odd, {}).collect()} == {"und"}
    assert language_id.predict(none, profiles).count() == 0


def test_toxicity_model_knows_misspellings(spark, odd, none):
    rng = random.Random(6)
    plain = [f"{a}{b}" for a in "ka lo mi nu pe ra so ti".split() for b in "len mor dit gas vup".split()]
    bad = ["horrible", "stinking", "wretched"]

    def text(toxic, n=60):
        w = [rng.choice(plain) for _ in range(n)]
        if toxic:
            w[rng.randrange(n)] = rng.choice(bad)
        return " ".join(w)

    labels = [i % 2 for i in range(400)]
    model = toxicity.train([text(y) for y in labels], labels)
    rows = [(i, text(i % 2, 300)) for i in range(100)] + [(200, text(0) + " horribble stinkinng"), (201, None), (202, "")]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert sum(got[i].predicted == i % 2 for i in range(100)) >= 97
    assert got[200].predicted == 1 and got[201].score == got[202].score < 0.5
    clash = toxicity.score(odd, model)
    assert clash.columns.count("score") == 1 and clash.where("score is null").count() == 0
    assert toxicity.score(none, model).count() == 0 and toxicity.train([], []).bias < 0
    keys = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (77, 1)] + [(i, i % 2) for i in range(100, 500)], "key long, label long")
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None)] + [(i, "t" * 40) for i in range(100, 500)], "key long, text string")
    assert sorted(toxicity.sample(docs.where("key < 4"), keys)) == [("", 0), ("a", 1)]
    assert len(toxicity.sample(docs, keys)) == 402 and 40 < len(toxicity.sample(docs, keys, most=50)) < 170
    assert sum(len(t) for t, _ in toxicity.sample(docs, keys, most_bytes=4000)) < 6500
    assert toxicity.sample(docs.limit(0), keys) == []


def test_toxicity_sample_shuffles_no_texts(spark):
    docs = spark.createDataFrame([(i % 90, f"text {i}") for i in range(100)], "key long, text string")
    keys = spark.createDataFrame([(i, i % 2) for i in range(90)], "key long, label int")

    def bare_joins(plan):
        inner = [j for i in range(plan.children().size()) for j in bare_joins(plan.children().apply(i))]
        return inner + [plan] * (plan.nodeName() == "Join" and "broadcast" not in plan.hint().toString())

    some = toxicity.chosen(docs, keys, most=10)
    joins = bare_joins(some._jdf.queryExecution().optimizedPlan())
    assert joins and not any("text" in j.output().mkString(",") for j in joins)
    assert {r.key: r.text for r in toxicity.chosen(docs, keys).collect()} == {
        i: min([f"text {i}"] + [f"text {i + 90}"] * (i < 10)) for i in range(90)}


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op10_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = Counter((r.toxic, r.predicted) for r in got.where("toxic is not null").collect())
    assert n[(1, 1)] >= 0.85 * (n[(1, 0)] + n[(1, 1)]) and n[(0, 1)] <= 0.05 * (n[(0, 0)] + n[(0, 1)])


def test_extra_columns_called_like_an_operator_s_own_come_back(spark, odd):
    """Every name that an operator gives a column inside, as the user's."""
    names = ["row", "key", "txt", "nth", "whole", "lines", "gone", "left", "h", "rep", "size", "taken", "_txt", "_nth", "_order", "_ls",
             "_words", "_lines", "_wins", "_gone", "_k", "_t", "_all", "_key", "_some", "_same", "_starts", "part", "guest", "doc", "d", "t"]
    names = [n for n in names if n not in odd.columns]
    mine = odd.withColumns({n: F.concat(F.lit(n + "="), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for n in names})
    for f in (line_dedup.dedup_lines, quality_rules.judge, jaccard_join.one_of_each, mixing.mixed_documents):
        out = f(mine)
        assert set(mine.columns) <= set(out.columns), f
        for r in out.collect():
            assert all(r[n] == f"{n}={'?' if r.doc_id is None else r.doc_id}" for n in names), f


def test_keys_stay_exact_beside_a_null(spark):
    big = 2 ** 53 + 1
    rows = [(k, f"text number {i} of some words that differ here", "en") for i, k in enumerate([None, big, big + 2, big + 4, 3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    want = {k for k, _, _ in rows}
    outs = [fingerprints.fingerprints(docs), packing.pack(docs, tokens.vocabulary()), jaccard_join.similar_components(docs), mixing.mix(docs),
            quality_rules.judge(docs), line_dedup.dedup_lines(docs), language_id.predict(docs, {"en": [97, 98]}),
            toxicity.score(docs, toxicity.Model(np.zeros(1 << toxicity.BUCKETS_BITS), 0.0))]
    for out in outs:
        assert {r.doc_id for r in out.collect()} == want
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")
    chats = chat_format.format_conversations(turns, tokens.vocabulary())
    assert {r.conv_id for r in chats.collect()} == {r.conv_id for r in chat_format.read_back(chats, tokens.vocabulary()).collect()} == want


def test_fingerprints_of_texts_without_spaces():
    rng = random.Random(3)
    a = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(3000))
    b = a[:2000] + "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(1000))
    assert 0.6 < fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b)) < 0.75
    line = ("word " * 40).encode() + b"x" * 300 + b" tail" + b"	cell" * 90
    assert b" ".join(fingerprints.leaves(line, {})).replace(b" ", b"") == line.replace(b" ", b"")


def test_pieces_of_one_length_are_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_PIECES", 7)
    docs = spark.createDataFrame([(i, "same text here") for i in range(100)], "doc_id long, text string")
    got = packing.pack(docs, tokens.vocabulary(), most=16).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 100 and len({r.sequence_id for r in got}) == 25


@pytest.mark.parametrize("hot_apart", [True, False])
def test_linked_sets_whose_equal_parts_are_empty_share_a_signature(hot_apart):
    bounds = jaccard_join.size_bounds(90, 1 << 12)
    assert jaccard_join.parts_of(bounds, 2, 90) == 4
    rng = np.random.default_rng(3)
    for _ in range(50):
        cold = rng.integers(1, 1 << 62, 6, dtype=np.uint64)          # all in the first of four parts
        hot = rng.integers(1, 1 << 62, 4, dtype=np.uint64) + np.uint64((1 << 62) if hot_apart else 0)
        larger = np.unique(np.concatenate([cold, hot]))
        smaller = larger[larger != cold[0]]                           # 9 of 10 shingles: linked at 90 %
        assert len(smaller) == 9
        for frequent in (np.sort(hot), np.zeros(0, np.uint64)):
            a, b = (jaccard_join.signatures(u, 90, bounds, frequent) for u in (smaller, larger))
            assert len(np.intersect1d(a, b)) and len(np.unique(a)) == len(a)

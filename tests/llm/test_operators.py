"""Each operator against plain Python, on awkward rows: NULLs, empty and long texts, ties, repeated rows,
empty tables and columns that clash."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as contract
from hostlake.llm import byte_bpe, cross_polytope, decontamination, line_dedup, lm_scoring, near_dedup, quality, sharding, substring_dedup, token_counts
from hostlake.llm.components import connected_components
from hostlake.llm.queries import BYTE_RANKS, PIECES

from tests.llm.conftest import BLANK_WORD, EXTRA, ITEM_WORD, LOWER, components, contamination, frame, lines, substrings


def got(df, *columns):
    return collections.Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*columns).collect())


def odd(rows):
    """Repeated rows and NULL ids besides."""
    return [*rows, rows[7], rows[7], (None, rows[11][1]), (None, None), (None, "x\nA Line that several documents HOLD")]


def items(rows):
    passage = rows[7][1].split()
    return [(1, " ".join(passage[5:30])), (2, "one two three"), (3, None), (4, ""), (10, " ".join(passage[20:45]).upper()), (10, "one two three"), (None, "short"), (5, "the the the the the the the the the the the")]


def test_decontamination(engine, rows):
    docs = odd(rows)
    bench = engine.createDataFrame(items(rows), "item_id long, text string").withColumn("word", F.lit(1))
    found = decontamination.decontaminate(frame(engine, docs, EXTRA), bench)
    want = collections.Counter((d, n, h, tuple(i), len(i), h > 0) for d, n, h, i in contamination(docs, items(rows)))
    assert got(found, "doc_id", "n_words", "n_hit", "items", "n_items", "contaminated") == want
    assert {"shard", "score"} <= set(found.columns)


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_decontamination_without_broadcast(engine, rows, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", bound)
    bench = engine.createDataFrame(items(rows), "item_id long, text string")
    found = decontamination.decontaminate(frame(engine, rows), bench)
    assert got(found, "doc_id", "n_hit") == collections.Counter((d, h) for d, _, h, _ in contamination(rows, items(rows)))


def test_decontamination_is_native(engine, rows):
    bench = engine.createDataFrame(items(rows), "item_id long, text string")
    plan = decontamination.decontaminate(frame(engine, rows), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Nested" not in plan


def test_winnowing_keeps_a_print_of_every_span(engine):
    rng = random.Random(1)
    shared = [rng.choice("abcdefgh") for _ in range(10)]
    docs = [(k, " ".join([*(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))), *shared, *(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))])) for k in range(200)]
    bench = engine.createDataFrame([(1, " ".join(shared))], "item_id long, text string")
    found = decontamination.decontaminate(frame(engine, docs), bench)
    assert found.where("contaminated").count() == 200


def test_words_that_come_again_are_not_encoded_again():
    """Three hundred thousand different words stay within reach."""
    encoder, asked = byte_bpe.Encoder({bytes([b]): b for b in range(256)}, public_tokenizers.PATTERN), []
    encoder.transducer.encode = lambda piece: asked.append(piece) or (0,)
    words = ["".join(chr(97 + n // 26**k % 26) for k in range(5)) for n in range(300_000)]
    for _ in range(2):
        encoder.encode(" ".join(words))
    assert len(asked) == len(set(asked))


def test_a_full_table_of_arcs_stays_for_long():
    """Words beyond it are followed without arcs; it is made anew when it has failed often enough."""
    encoder = byte_bpe.Encoder(byte_bpe.read_ranks(BYTE_RANKS), public_tokenizers.PATTERN, 64)
    transducer, words = encoder.transducer, ["".join(chr(97 + n * 7 // 26**k % 26) for k in range(5)) for n in range(4_000)]
    for word in words[:100]:
        for _ in range(6):
            transducer.encode(word.encode())
    first = transducer.arcs
    transducer.encode(words[-1].encode())
    assert transducer.arcs is first and 64 <= transducer.made < 80
    for word in words[100:] * 3:
        transducer.encode(word.encode())
    assert transducer.arcs is not first and transducer.made < 80


def test_byte_bpe(engine, rows):
    ranks = byte_bpe.read_ranks(BYTE_RANKS)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd(rows)
    coded = byte_bpe.encode(frame(engine, docs, EXTRA), BYTE_RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decode(coded, BYTE_RANKS)
    want = collections.Counter((d, tuple(known.encode_ordinary(t or "")), t or "") for d, t in docs)
    assert got(back, "doc_id", "ids", "decoded") == want
    assert got(byte_bpe.code(frame(engine, docs, EXTRA), BYTE_RANKS, public_tokenizers.PATTERN), "doc_id", "ids", "decoded") == want


@pytest.mark.parametrize("arcs", [64, 1 << 18])
def test_transducer_equals_merging(arcs):
    ranks = byte_bpe.read_ranks(BYTE_RANKS)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN, arcs)
    rng, tokens = random.Random(2), list(ranks)
    for _ in range(3000):
        text = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 7))).decode("utf-8", "ignore")
        assert encoder.encode(text).tolist() == known.encode_ordinary(text)
    for text in ("a" * 5000, "ab" * 3000, " " * 999 + "x", "\n" * 50):
        assert encoder.encode(text).tolist() == known.encode_ordinary(text)


def test_stream_decoder_carries_cut_characters():
    ranks = byte_bpe.read_ranks(BYTE_RANKS)
    decoder = byte_bpe.StreamDecoder({r: t for t, r in ranks.items()})
    raw = "é😀".encode()
    parts = [decoder.feed([ranks[bytes([b])]]) for b in raw]
    assert parts == ["", "é", "", "", "", "😀"]
    assert decoder.text([ranks[b"\xff"], ranks[b"a"]]) == "�a"


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_near_duplicates(engine, rows, monkeypatch, bound):
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", bound)
    docs = odd(rows)
    found = near_dedup.near_duplicates(frame(engine, docs, EXTRA), size=4)
    want = collections.Counter((d, n, c if n else d, d == (c if n else d)) for d, n, c in components(docs, 4))
    assert got(found, "doc_id", "n_shingles", "component_id", "kept") == want


def test_near_duplicates_links_between_components_of_a_bucket(engine):
    """Chains of texts in which neighbours are similar and the ends are not."""
    rng = random.Random(4)
    words = [str(rng.random()) for _ in range(200)]
    docs = []
    for k in range(25):
        docs.append((k, " ".join(words)))
        for _ in range(4):
            words[rng.randrange(200)] = str(rng.random())
    found = near_dedup.near_duplicates(frame(engine, docs))
    assert got(found, "doc_id", "n_shingles", "component_id") == collections.Counter(components(docs, 5))


def test_components(engine):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1040)]
    root = {x: x for pair in links for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert {tuple(r) for r in connected_components(engine.createDataFrame(links, "a long, b long")).collect()} == set(root.items())


def test_lines(engine, rows):
    docs = odd(rows)
    found = line_dedup.dedup_lines(frame(engine, docs, EXTRA))
    assert got(found, "doc_id", "n_lines", "n_dropped", "kept_text") == collections.Counter(lines(docs))


def test_lines_with_many_shards_and_copies(engine, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 1)
    monkeypatch.setattr(line_dedup, "LINES_PER_COPY", 2)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    docs = [*rows, (200, "line number one\nline number two"), (201, "line number two\nline number one\n")]
    found = line_dedup.dedup_lines(frame(engine, docs))
    assert got(found, "doc_id", "n_lines", "n_dropped", "kept_text") == collections.Counter(lines(docs))


def test_few_repeated_lines_are_probed_by_many_tasks(engine, monkeypatch):
    monkeypatch.setattr(line_dedup, "LINES_PER_COPY", 100)
    docs = [(k, "\n".join([f"line number {n} of {k}" for n in range(10)] + ["the one line that all repeat"][: k % 3])) for k in range(300)]
    found = line_dedup.hashed_lines(frame(engine, docs), 10, "doc_id", "text").cache()
    repeated = line_dedup.repeated_lines(found)
    assert repeated.count() == 1
    shards = line_dedup.build_shards(repeated, 1, found.count()).cache()
    sizes = [r["count"] for r in line_dedup.dealt(found, shards, 1).groupBy("shard", "salt").count().collect()]
    assert len(sizes) >= 32 and sum(sizes) == found.count() and max(sizes) < 200
    assert got(line_dedup.dedup_lines(frame(engine, docs)), "doc_id", "n_lines", "n_dropped", "kept_text") == collections.Counter(lines(docs))


def test_perfect_hash():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    a[1] = a[0]
    made = line_dedup.PerfectHash.build(a, b)
    assert sorted(made.places(a, b)) == list(range(5000))


def test_substrings(engine, rows):
    docs = odd(rows)
    found = substring_dedup.dedup_substrings(frame(engine, docs, EXTRA))
    assert got(found, "doc_id", "n_words", "n_removed", "kept_text") == collections.Counter(substrings(docs, 35))


def test_substrings_over_many_blocks_and_passes(engine, rows, monkeypatch):
    for name, value in (("BLOCK_BYTES", 2000), ("BUCKET_PIECES", 20), ("PART_PIECES", 3), ("PASS_WINDOWS", 50)):
        monkeypatch.setattr(substring_dedup, name, value)
    found = substring_dedup.dedup_substrings(frame(engine, rows))
    assert got(found, "doc_id", "n_words", "n_removed", "kept_text") == collections.Counter(substrings(rows, 35))


def test_substrings_split_a_hot_minimiser():
    """A run of twelve words that all texts share, in different surroundings: its windows spread over buckets."""
    rng = random.Random(5)
    run = " ".join(f"hot{k}" for k in range(12))
    some = lambda: " ".join(str(rng.random()) for _ in range(30))
    texts = [f"{some()} {run} {some()}".encode() for _ in range(300)]
    hashes = substring_dedup.WordHashes()
    windows = [substring_dedup.minimisers(hashes.of(t.split()), 35)[1] for t in texts]
    every = np.unique(np.concatenate(windows))

    def largest(parts):
        block = substring_dedup.Block([(b"k" * 16, t, every, np.full(every.size, parts)) for t in texts], 35, 16, hashes)
        sizes = collections.Counter()
        for bucket, _, _, _, count, known, _, _ in block.rows():
            sizes[bucket] += 0 if known is None else int(count.sum())
        assert sum(sizes.values()) == sum(w.size for w in windows)
        return max(sizes.values()) / sum(sizes.values())

    assert largest(64) < 1.5 / 16


def test_substrings_leave_texts_without_repeats_at_home(engine):
    rng = random.Random(6)
    own = [(k, " ".join(str(rng.random()) for _ in range(80))) for k in range(200)]
    twice = own[3][1].split()[20:60]
    docs = [*own, (500, " ".join(["before", *twice, "after"]))]
    source = frame(engine, docs).select(F.lit(1).alias("doc"), "text")
    repeated = substring_dedup.repeated_minimisers(substring_dedup.pieces(source, 35)).collect()
    assert 0 < len(repeated) <= 6
    assert got(substring_dedup.dedup_substrings(frame(engine, docs)), "doc_id", "n_words", "n_removed", "kept_text") == collections.Counter(substrings(docs, 35))


def sized(engine, rows, **more):
    text = F.coalesce("text", F.lit(""))
    return frame(engine, rows, **more).withColumns({"size": sharding.text_size(F.col("text")), "text_hash": F.xxhash64(text)})


def test_sharding(engine):
    rng = random.Random(7)
    docs = [(k, "x" * rng.randint(0, 60)) for k in range(3000)] + [(k, "hot text") for k in range(3000, 5000)] + [(7, "same row")] * 500 + [(None, None)] * 3
    found = sharding.shard(sized(engine, docs), 24).select("doc_id", "size", "shard", "slot").collect()
    assert len(found) == len(docs)
    total = collections.Counter()
    slots = collections.defaultdict(list)
    for r in found:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total.values()) - min(total.values()) <= 2 * 68


def test_sharding_subdivides_overfull_ranges(engine, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 1)
    docs = [(k, "y" * (k % 50)) for k in range(4000)]
    found = sharding.shard(sized(engine, docs, extra=["slot", "key"]), 6).groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    assert len(found) == 6 and all(r["m"] == r["n"] - 1 for r in found)
    assert max(r["b"] for r in found) - min(r["b"] for r in found) <= 2 * 58


def test_token_counts(engine, rows):
    pieces, byte = token_counts.read_pieces(PIECES)

    def count(word):
        word = token_counts.BLANK + word
        best = [(0.0, 0)] + [None] * len(word)
        for end in range(1, len(word) + 1):
            spelt = len(word[end - 1].encode())
            options = [(best[end - 1][0] + spelt * byte, best[end - 1][1] + spelt)]
            options += [(best[s][0] + pieces[word[s:end]], best[s][1] + 1) for s in range(max(0, end - 20), end) if word[s:end] in pieces]
            best[end] = max(options, key=lambda o: (o[0], -o[1]))
        return best[-1][1]

    docs = odd(rows)
    found = token_counts.count_tokens(frame(engine, docs, EXTRA), PIECES)
    want = collections.Counter((d, len((t or "").split()), sum(map(count, (t or "").split()))) for d, t in docs)
    assert got(found, "doc_id", "n_pretokens", "n_tokens") == want


def test_token_trie_shares_prefixes_and_may_be_emptied():
    pieces, byte = token_counts.read_pieces(PIECES)
    trie, small = token_counts.CountingTrie(pieces, byte), token_counts.CountingTrie(pieces, byte, max_nodes=5)
    words = [token_counts.BLANK + w for w in ("there", "therefore", "them", "x", "日本")]
    assert [trie.terminal(w) for w in words] == [small.terminal(w) for w in words]
    assert len(trie.score) - 1 == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_scores(engine, rows):
    docs = odd(rows) + [(k, f"one two three {k} the there") for k in range(400, 430)]
    found = lm_scoring.score_texts(frame(engine, docs, EXTRA), PIECES, head_words=20)
    tokens = [((str(d) if d is not None else ""), BLANK_WORD.findall((t or "").translate(LOWER)) + [None]) for d, t in docs]
    seen = collections.Counter(w for k, ws in tokens if zlib.crc32(k.encode()) % 5 != 1 for w in ws)
    total, floor = sum(seen.values()), sum(seen.values()) + 0.5 * (len(seen) + 1)
    want = collections.Counter(
        (d, zlib.crc32(k.encode()) % 5 == 1, len(ws), sum(seen[w] > 0 for w in ws), total, round(sum(math.log10((seen[w] + 0.5) / floor) for w in ws), 6))
        for (d, _), (k, ws) in zip(docs, tokens, strict=True)
    )
    assert got(found.withColumn("b", F.round("base_score", 6)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "b") == want
    assert all(r[0] < 0 and math.isfinite(r[0]) for r in found.select("score").collect())


def test_lattice_sums_all_segmentations():
    pieces = lm_scoring.Pieces({lm_scoring.BLANK: 1.0, lm_scoring.BLANK + "a": 0.5, "a": 0.4, "b": 0.3, "ab": 0.2, "ba": 0.1})
    logs = pieces.weights(np.array([3.0, 2, 4, 3, 2, 1, 1, 5]))[:, None]

    def paths(word, at=0):
        if at == len(word):
            return [0.0]
        out = []
        for end in range(at + 1, len(word) + 1):
            k = pieces.number.get(word[at:end])
            if k is not None and pieces.first[k] == (at == 0):
                out += [logs[k, 0] + rest for rest in paths(word, end)]
        if at:
            out += [len(word[at].encode()) * logs[pieces.byte, 0] + rest for rest in paths(word, at + 1)]
        return out

    for word in ("abba", "aaé", "b"):
        want = np.logaddexp.reduce(paths(lm_scoring.BLANK + word))
        assert abs(lm_scoring.Lattice(pieces, [word]).forward(logs)[-1, 0, 0] - want) < 1e-9
    # All words together have probability 1: spelling goes on until it stops.
    assert abs(np.exp(logs[pieces.first]).sum() - 1) < 1e-9
    rest = logs[~pieces.first, 0].copy()
    rest[-2] += math.log(256)
    assert abs(np.exp(rest).sum() - 1) < 1e-9


def test_scores_beat_the_base_on_held_out_texts(engine, sf_dir):
    found = contract.queries()["op5_subword_lattice"](engine, sf_dir.replace("sf0.001", "sf0.1")).where("held_out")
    base, score = found.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


def vectors(engine):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 24))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(1000 + k, x[5].tolist()) for k in range(300)] + [(2000 + k, (2 * x[6]).tolist()) for k in range(3)]
    bad = [(5000, None), (5050, []), (5100, [0.0] * 24), (5150, [None] * 24), (5200, [float("nan")] * 24), (5250, [float("inf")] * 24), (None, x[7].tolist())]
    return rows, bad, [(6000, [1.0, 2.0]), (6001, [2.0, 1.0]), (3, x[3].tolist())]


def test_nearest(engine):
    rows, bad, more = vectors(engine)
    df = engine.createDataFrame(rows + bad + more, "vec_id long, embedding array<double>").withColumn("rank", F.lit("?")).repartition(5)
    found = collections.defaultdict(list)
    for r in cross_polytope.nearest(df).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found[r["query_id"]]) + 1
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    every = dict(rows)
    ids, x = np.array(list(every)), np.array(list(every.values()))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = wanted = 0
    for k in np.flatnonzero(ids % 50 == 0):
        near = unit @ unit[k]
        near[k] = -9
        order = sorted(range(len(ids)), key=lambda j: (-round(near[j], 12), ids[j]))[:5]
        own = found[ids[k]]
        hits += len({ids[j] for j in order} & {v for v, _ in own})
        wanted += 5
        assert all(abs(near[np.flatnonzero(ids == v)[0]] - s) < 1e-12 for v, s in own)
    assert hits >= 0.9 * wanted
    assert found[6000] == [(6001, pytest.approx(0.8))]
    assert set(found) == {k for k in every if k % 50 == 0} | {6000}
    assert [v for v, _ in found[1000]] == [5, 1001, 1002, 1003, 1004]


@pytest.mark.parametrize("kind", ["scaled", "one-hot", "binary"])
def test_nearest_ties_go_to_smaller_ids(engine, monkeypatch, kind):
    monkeypatch.setattr(cross_polytope, "BLOCK", 16)
    rng = np.random.default_rng(9)
    n, base = 120, rng.integers(-9, 10, 16) / 4
    if kind == "scaled":
        x = np.array([base * 2.0 ** rng.integers(-40, 40) * rng.integers(1, 1000) for _ in range(n)])
    elif kind == "one-hot":
        x = np.array([np.eye(16)[k % 16] * (k + 1) for k in range(n)])
    else:
        x = np.array([rng.permutation([1.0] * 8 + [0.0] * 8) for _ in range(n)])
    ids = rng.permutation(n) + 30
    rows = [(int(i), [float(v) for v in vec]) for i, vec in zip(ids, x, strict=True)]
    monkeypatch.setattr(cross_polytope, "SETTINGS", cross_polytope.SETTINGS[-1:])
    found = collections.defaultdict(list)
    df = engine.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for r in cross_polytope.nearest(df, every=5).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 12) + 0.0
    for k in np.flatnonzero(ids % 5 == 0):
        want = sorted(((-near[k, j], int(ids[j])) for j in range(n) if j != k))[:5]
        assert [(v, pytest.approx(-s, abs=1e-12)) for s, v in want] == found[ids[k]]


def test_direction_is_what_parallel_vectors_share():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((50, 7)).astype(np.float32).astype(float)
    x[:, 3] = 0
    for factor in (1.0, 3.0, 2.0**-60, 7 * 2.0**70, 1e5):
        assert (cross_polytope.direction(x * factor) == cross_polytope.direction(x)).all()
    assert not (cross_polytope.direction(-x) == cross_polytope.direction(x)).all(axis=1).any()
    far = np.array([[1e-310, 3.0, -1e300], [5e-324, 0.0, 0.0]])
    assert (cross_polytope.direction(far)[1] == [0.5, 0, 0]).all() and np.isfinite(cross_polytope.direction(far)).all()
    unit, own = cross_polytope.unit(x), cross_polytope.direction(x)
    assert np.allclose(cross_polytope.cosines(own[:-1], own[1:]), (unit[:-1] * unit[1:]).sum(axis=1), atol=1e-14)


def test_nearest_finds_the_longer_vectors_of_a_mixed_table(engine):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 64))
    rows = [(1000 + k, v.tolist()) for k, v in enumerate(rng.normal(size=(800, 2)))] + [(k, v.tolist()) for k, v in enumerate(x)]
    found = collections.defaultdict(set)
    for r in cross_polytope.nearest(engine.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).collect():
        found[r["query_id"]].add(r["vec_id"])
    unit = cross_polytope.unit(x)
    want = {k: set(np.argsort(-(unit @ unit[k]))[1:6].tolist()) for k in range(0, 300, 10)}
    assert sum(len(found[k] & v) for k, v in want.items()) >= 0.9 * 150


def test_nearest_of_nothing(engine):
    empty = engine.createDataFrame([], "vec_id long, embedding array<double>")
    assert cross_polytope.nearest(empty).count() == 0


FOUL = ("trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron")


def test_quality_of_texts_that_neither_model_nor_limits_have_seen(engine, sf_dir):
    """Half of the labels are held out. A third of the texts labelled toxic holds no foul word, so those that do are
    counted; of low ones, those with signs between or after words (not those that repeat one plain word)."""
    folder = sf_dir.replace("sf0.001", "sf0.1")
    labels = engine.read.parquet(f"{folder}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    docs = engine.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    found = quality.classify(docs.withColumns({c: F.lit("?") for c in ("perplexity", "accepted", "gram", "fold")}), labels.where(half == 0))
    found = found.join(labels.where(half == 1), "doc_id").cache()
    rejected = lambda which: found.where(which).agg(F.avg((~F.col("accepted")).cast("int"))).first()[0]
    assert rejected("quality = 1 and toxic = 0") < 0.03
    assert rejected(F.lower("text").rlike(rf"\b({'|'.join(FOUL)})\b")) > 0.85
    assert rejected((F.col("quality") == 0) & F.col("text").rlike(r"%%%|###|\$\$\$|&&&|\*\*\*|!!| \| ")) > 0.95


def plain_kneser_ney(words, order):
    """Probability of a letter after others in a word, by the definition."""
    grams = {k: collections.Counter() for k in range(1, order + 1)}
    marked = [quality.START + w + quality.END for w in words]
    for w in marked:
        for end in range(2, len(w) + 1):
            grams[min(end, order)][w[max(0, end - order) : end]] += 1
    counts = {order: dict(grams[order])}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
        counts[k].update({g: n for g, n in grams[k].items() if k > 1 and g.startswith(quality.START)})
    discounts = {}
    for k, c in counts.items():
        n = {i: max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4)}
        y = n[1] / (n[1] + 2 * n[2])
        discounts[k] = {i: min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.01), i) for i in (1, 2, 3)}

    def probability(context, letter):
        k = len(context) + 1
        after = {g: v for g, v in counts[k].items() if g[:-1] == context}
        below = 1 / (len(counts[1]) + 1) if k == 1 else probability(context[1:], letter)
        if not after:
            return below
        total, d = sum(after.values()), discounts[k]
        back = sum(d[min(v, 3)] for v in after.values()) / total
        v = after.get(context + letter, 0)
        return (v - d[min(v, 3)] if v else 0) / total + back * below

    return lambda word: sum(math.log10(probability(word[max(0, i - order + 1) : i], word[i])) for i in range(1, len(word)))


def test_letters_equal_plain_kneser_ney(engine):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("aabbcde", k=rng.randint(1, 7))) for _ in range(30)) for _ in range(20)]
    labels = engine.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    docs = engine.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    letters = quality.Letters([tuple(r) for r in quality.fit(docs, labels).collect()], quality.ORDER)
    plain = plain_kneser_ney(" ".join(texts).split(), quality.ORDER)
    asked = ["abba", "a", "eeeeee", "xyz", "abxab", "cde", "bca"]
    assert np.allclose(letters.words(asked), [plain(quality.START + w + quality.END) for w in asked])


def test_no_model_has_seen_the_fold_it_scores(engine):
    labels = engine.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    docs = engine.createDataFrame([(k, chr(97 + k % 26) * 5 if k < 26 else "none", "en") for k in range(40)], "doc_id long, text string, lang string")
    sample = quality.training_sample(labels)
    folds = dict(sample.collect())
    grams = collections.defaultdict(set)
    for r in quality.models(docs, sample).collect():
        grams[r["model"]].add(r["gram"])
    for k in range(26):
        gram = chr(97 + k) * 4
        assert gram not in grams[folds[k]] and all(gram in grams[m] for m in range(quality.FOLDS + 1) if m != folds[k])


def test_few_documents_of_a_language_lean_on_all(engine):
    """The limits of a language lie between its own and all languages' quantiles, and near its own with many documents."""
    def limits(n):
        rows = [("en", 64, 10.0)] * 1000 + [("de", 64, 1000.0)] * n
        frame_ = engine.createDataFrame(rows, "lang string, n_distinct long, x double")
        trusted = frame_.select("lang", "n_distinct", *(F.col("x").alias(c) for c in quality.PERPLEXITIES))
        return {(r[0], r[1]): r[2] for r in quality.thresholds(trusted, ["en", "de"], 0.9)}

    few, many = limits(3), limits(1500)
    assert few["de", 6] < 11 < 990 < many["de", 6]
    assert few["en", 6] < 11 and many["en", 6] < 11 and few[None, 6] < 11


def test_quality_judges_short_texts_by_short_texts_and_all_kinds_of_words(engine):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bdlmn") + rng.choice("aeiou") for _ in range(3))
    foul = lambda: "".join(rng.choice("qzxwvkj") for _ in range(8))
    short = [" ".join(word() for _ in range(12)) for _ in range(60)]
    long = [" ".join(foul() if k % 3 == 0 else word() for k in range(200)) for _ in range(60)]
    asked = [f"{short[0]} {foul()}", f"{short[1]} xq", f"{short[2]} {foul()[:4]}-9{foul()[:4]}", short[3], long[3]]
    docs = engine.createDataFrame([(k, t, "en") for k, t in enumerate(short + long + asked)], "doc_id long, text string, lang string")
    labels = engine.createDataFrame([(k, 1, 0) for k in range(120)], "doc_id long, quality int, toxic int")
    found = dict(quality.classify(docs, labels).select("doc_id", "accepted").collect())
    assert [found[120 + k] for k in range(5)] == [False, False, False, True, True]


def test_quality_of_awkward_rows(engine, rows):
    docs = odd(rows)
    ids = [d for d, _ in docs if d is not None]
    labels = [(d, 1, 0) for d in ids[7:14]] + [(ids[7], 0, 0), (None, 1, 0), (ids[3], None, None)]
    frame_ = frame(engine, docs, EXTRA)
    found = quality.classify(frame_, engine.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = found.select("doc_id", "text", "accepted").collect()
    assert len(out) == len(docs)
    assert all(r["accepted"] for r in out if not (r["text"] or "").split())
    nothing = quality.classify(frame_, engine.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert nothing.where("accepted").count() == len(docs)


def test_kneser_ney_probabilities_sum_to_one(engine):
    docs = frame(engine, [(k, "aba abba baab aa bab cab") for k in range(9)])
    labels = engine.createDataFrame([(k, 1, 0) for k in range(9)], "doc_id long, quality int, toxic int")
    rows = [tuple(r) for r in quality.fit(docs, labels).collect()]
    letters = quality.Letters(rows, quality.ORDER)
    outcomes = ["a", "b", "c", quality.END, "?"]
    for context in (quality.START, quality.START + "ab", quality.START + "bba", quality.START + "ca"):
        logs = [letters.letter_logs(quality._letters(context + x), np.arange(len(context) + 1) + 1)[-1] for x in outcomes]
        assert np.allclose(sum(10**x for x in logs), 1, atol=0.02)


def test_long_texts_are_scored_like_short_ones(engine, monkeypatch):
    docs = frame(engine, [(k, "aba abba baab aa bab cab") for k in range(9)])
    labels = engine.createDataFrame([(k, 1, 0) for k in range(9)], "doc_id long, quality int, toxic int")
    rows = [tuple(r) for r in quality.fit(docs, labels).collect()]
    text = "abba clown baab cabba bbbbb aaaaa clown " * 9
    whole = quality.Scorer(quality.Letters(rows, quality.ORDER)).documents([text, "", "abba"])
    monkeypatch.setattr(quality, "BLOCK_WORDS", 5)
    monkeypatch.setattr(quality, "MAX_WORDS", 6)
    parts = quality.Scorer(quality.Letters(rows, quality.ORDER)).documents([text, "", "abba"])
    assert np.allclose(np.array(whole), np.array(parts))


def test_empty_tables(engine, rows):
    none, items_ = frame(engine, [], EXTRA), engine.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(none, items_).count() == 0
    assert decontamination.decontaminate(frame(engine, rows), items_).where("contaminated").count() == 0
    assert byte_bpe.encode(none, BYTE_RANKS, public_tokenizers.PATTERN).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert lm_scoring.score_texts(none, PIECES).count() == 0
    assert sharding.shard(sized(engine, [])).count() == 0
    assert quality.classify(none, engine.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert token_counts.count_tokens(none, PIECES).count() == 0
    assert substring_dedup.dedup_substrings(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0


def test_models_see_all_trusted_documents(engine):
    """The only document with a word is found wherever the order of hashes puts it; nothing limits how many are read."""
    n = 20_500
    labels = engine.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.training_sample(labels).count() == n
    last = labels.orderBy(F.xxhash64("doc_id").desc(), F.col("doc_id").desc()).first()[0]
    text = F.when(F.col("doc_id") == last, F.lit("qqqq")).otherwise(F.lit("a"))
    docs = labels.select("doc_id", text.alias("text"), F.lit("en").alias("lang"))
    assert quality.fit(docs, labels).where("gram = 'qqqq'").count() == 1


def test_a_model_too_large_to_broadcast_scores_alike(engine, rows, monkeypatch):
    docs = odd([*rows, *((1000 + k, f"{t} qqqqqq, zz-9") for k, (_, t) in enumerate(rows[9:13]))])
    labels = engine.createDataFrame([(d, 1, 0) for d, _ in docs[:14] if d is not None], "doc_id long, quality int, toxic int")
    names = ["doc_id", "lang", "n_tokens", "n_distinct", *quality.PERPLEXITIES, *quality.PERPLEXITIES.values(), "accepted"]
    order = lambda found: sorted(map(tuple, found.select(*names).collect()), key=lambda r: str((r[0], r[1], r[2])))
    frame_ = frame(engine, docs, EXTRA)
    small = order(quality.classify(frame_, labels, without=["text"]))
    monkeypatch.setattr(quality, "MODEL_CELLS", 0)
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    large = order(quality.classify(frame_, labels, without=["text"]))
    assert [r[:4] + r[-1:] for r in small] == [r[:4] + r[-1:] for r in large]
    assert np.allclose(np.array([r[4:-1] for r in small], float), np.array([r[4:-1] for r in large], float))


def test_words_are_counted_without_matching_each_of_them(engine, rows):
    texts = [t for _, t in rows] + [" a", "a ", " a ", "A", "Z z", "[A`b]", "é", " é-日本 ", "\x7f", "a\x7fB", "😀 😀", "--", "0:9"]
    found = engine.createDataFrame([(t,) for t in texts], "text string").select("text", decontamination.word_count(F.col("text")).alias("n")).collect()
    assert len(found) == len(texts)
    assert all(r["n"] == len(ITEM_WORD.findall((r["text"] or "").translate(LOWER))) for r in found)

"""The operators against plain versions, exact round trips and held-out accuracy."""

import collections
import itertools
import hashlib
import io
import re
import wave
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard

from apchecks.llm import anisotropic, audio, ctw, licences, mixing, packing, parity_join, queries, token_store, tokens, toxicity
from apchecks.llm.common import materialize
from apchecks.llm.textops import NOT_ALNUM, slices, word_hashes, words

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def texts(folder=SMALL):
    return duckdb.sql(f"select doc_id, text, source from '{folder}/documents.parquet' order by doc_id").fetchall()


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("separators,pattern", [(None, r"[^\x20\x09-\x0D]+"), (NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words(separators, pattern):
    rows = [t for _, t, _ in texts()][:60] + ["", None, " ", "a", "Ab é\x0b\x1cç 9-x"]
    for s in slices(pa.array(rows), limit=5000):
        w = words(s) if separators is None else words(s, separators)
        h = word_hashes(s, w)
        for r in range(s.rows):
            expected = re.findall(pattern, (rows[s.first + r] or "").translate(LOWER))
            got = [s.data[w.starts[i] : w.ends[i]].tobytes().decode() for i in range(w.first[r], w.first[r + 1])]
            assert got == expected
            assert len(set(h[w.first[r] : w.first[r + 1]].tolist())) == len(set(expected))


def test_base_score_and_normalised_model(spark):
    rows = texts()
    p = ctw.score(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), max_broadcast=64).toPandas().set_index("doc_id")
    counts = collections.Counter()
    for i, t, _ in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*split(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t, _ in rows:
        tokens_ = [*split(t), None]
        assert p.n_tokens[i] == len(tokens_) and p.train_tokens[i] == n and p.n_known[i] == sum(counts[w] > 0 for w in tokens_)
        assert p.base_score[i] == pytest.approx(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens_), rel=1e-6)
    whole = ctw.score(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")).toPandas().set_index("doc_id")
    assert np.allclose(p.score, whole.score[p.index], rtol=1e-5)
    # All 256 next bytes of one context have a total probability of 1.
    tree = np.array([int.from_bytes(b"\0the " + bytes([c]), "big") for c in b"aabz "], dtype=np.uint64)
    upper = ctw._Upper(ctw._top_nodes(__import__("pandas").DataFrame({"key": tree.view(np.int64), "train": [5, 3, 1, 0, 2]})))
    every = np.concatenate((tree, np.array([int.from_bytes(b"\0the " + bytes([c]), "big") for c in range(256)], dtype=np.uint64)))
    code = ctw._code(every, np.concatenate(([5, 3, 1, 0, 2], np.zeros(256, int))), upper)
    assert (10 ** code[5:]).sum() == pytest.approx(1.0)


def test_held_out_texts_cost_less_than_base(spark):
    p = ctw.score(spark.read.parquet(f"{MEDIUM}/documents.parquet")).toPandas()
    held = p[p.held_out]
    assert len(held) > 50 and held.score.sum() > held.base_score.sum()


def encoded(rows):
    e = tokens.Encoder(queries.tokenizer_path())
    return {i: np.array(e.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for i, t, _ in rows}


def test_encoder_is_the_tokenizer():
    e = tokens.Encoder(queries.tokenizer_path())
    rng = np.random.default_rng(5)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "1", ".", "'s", "\x1c", "\x85", "<|endoftext|>", "中", "​", "\x0b", "\r\n", "xxx", " ", ",,", "²", "»"]
    rows = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(4000)]
    for t, got in zip(rows, e.encode(rows)):
        assert np.frombuffer(got, "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_store_round_trip(spark):
    rows = texts()
    ids = encoded(rows)
    manifest = token_store.write_shards(spark.read.parquet(f"{SMALL}/documents.parquet"), queries.tokenizer_path(), 0)
    start = 0
    for r in sorted(token_store.read_shards(manifest).collect(), key=lambda r: r["doc_id"]):
        expected = ids[r["doc_id"]] + struct.pack("<I", 0)
        assert (r["start"], bytes(r["ids"])) == (start, expected)
        start += len(expected) // 4
    some = {r["doc_id"]: bytes(r["ids"]) for r in token_store.read_documents(spark, manifest, [3, 77, 10**9]).collect()}
    assert some == {i: ids[i] + struct.pack("<I", 0) for i in (3, 77)}
    path = manifest.orderBy("shard").first()["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    first = zstandard.ZstdDecompressor().decompressobj().decompress(bytes(data))
    assert first == ids[min(ids)] + struct.pack("<I", 0)
    data[-13] ^= 1  # a checksum in the seek table
    broken = pa.BufferReader(bytes(data))
    reader = token_store.ShardReader(broken)
    with pytest.raises(ValueError):
        for i in range(len(reader)):
            reader.read(i)


def test_packing_is_whole_and_tight(spark):
    rows = texts(MEDIUM)
    ids = {i: v + struct.pack("<I", 1) for i, v in encoded(rows).items()}
    p = packing.pack(spark.read.parquet(f"{MEDIUM}/documents.parquet").coalesce(2), queries.tokenizer_path(), 1).toPandas()
    rebuilt = collections.defaultdict(bytes)
    for r in p.sort_values(["doc_id", "start"]).itertuples():
        assert r.start == len(rebuilt[r.doc_id]) // 4
        rebuilt[r.doc_id] += bytes(r.ids)
    assert dict(rebuilt) == ids
    for _, g in p.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate(([0], np.cumsum(g.length)[:-1]))).all() and g.length.sum() <= 2048
    full = p.groupby("sequence_id").length.sum()
    assert (full < 2048).sum() <= 2


def test_level_packer_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    packer = packing.LevelPacker(16)
    for length in rng.integers(1, 17, 300):
        before = packer.count.copy()

        def cost(h):
            after = before.copy()
            if h:
                after[h] -= 1
            if h + length < 16:
                after[h + length] += 1
            return int((after[1:16] ** 2).sum())

        options = [0, *(h for h in range(1, 17 - length) if before[h] > 0)]
        _, chosen = packer.place(int(length))
        assert chosen in options and cost(chosen) == min(map(cost, options))


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 50)])
def test_parity_join(spark, k, percent):
    rng = np.random.default_rng(k)
    rows = [(i, t) for i, t, _ in texts()]
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    for i in range(150):  # a group of near copies at many similarities
        edited = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 9)):
            edited[at] = f"e{rng.integers(0, 10**6)}"
        rows.append((1000 + i, " ".join(edited)))
    sets = {}
    for i, t in rows:
        w = split(t)
        sets[i] = set(zip(*[w[j:] for j in range(k)])) if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), root(i)) for i, s in sets.items()}


def test_mixing_meets_targets(spark):
    p = mixing.mix_plan(spark.read.parquet(f"{MEDIUM}/documents.parquet")).toPandas()
    size = p.groupby("source")["size"].sum()
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size.index))}
    capped, total = set(), 1.5 * size.sum()
    while True:
        free = {s for s in size.index if s not in capped}
        left = total - sum(2 * size[s] for s in capped)
        target = {s: 2 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in size.index}
        over = {s for s in free if target[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    for s, g in p.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(target[s]) and abs(g.taken.sum() - target[s]) <= 1
        assert (g.taken <= 2 * g["size"]).all() and (g.cut > 0).sum() <= 1
    again = mixing.mix_plan(spark.read.parquet(f"{MEDIUM}/documents.parquet").repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert (p[key].sort_values("doc_id").to_numpy() == again[key].sort_values("doc_id").to_numpy()).all()


def test_mix_keeps_every_text_of_an_id(spark):
    texts = [(None, f"no id {i}", None) for i in range(100)] + [(7, f"one id {i}", None) for i in range(5)]
    texts += [(8, "same text twice", None), (8, "same text twice", None), (9, "other column", "a"), (9, "other column", "b"), (9, "other column", None)]
    docs = spark.createDataFrame([(i, t, "s", m) for i, t, m in texts], "doc_id long, text string, source string, mark string").repartition(3)
    plan = mixing.mix_plan(docs).toPandas()
    got = collections.Counter((r["doc_id"], r["text"], r["mark"]) for r in mixing.mix(docs).collect())
    cut = (plan.cut > 0).sum()
    assert cut <= 1 and sum(got.values()) == plan.copies.sum() + cut
    for row, repeats in collections.Counter(texts).items():
        assert repeats <= got[row] <= 2 * repeats, row


def test_exchange_keeps_mass_and_expectation():
    rng = np.random.default_rng(1)
    for _ in range(200):
        p, q, w, v = *rng.uniform(0.01, 0.99, 2), *rng.integers(1, 50, 2)
        a, b = mixing.exchange(p, w, q, v, rng.random())
        assert a * w + b * v == pytest.approx(p * w + q * v) and (a in (0, 1) or b in (0, 1))
    mean = np.mean([mixing.exchange(0.3, 5, 0.6, 2, u) for u in (np.arange(2000) + 0.5) / 2000], axis=0)
    assert mean == pytest.approx([0.3, 0.6], abs=1e-3)


def test_suffix_automaton_statistics():
    rng = np.random.default_rng(2)
    sequences = [rng.integers(0, 3, n).tolist() for n in (8, 12, 5)]
    automaton = licences.Automaton.build(sequences)
    factors = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = rng.integers(0, 4, 200).tolist()
    for i, (_, length) in enumerate(automaton.statistics(text)):
        longest = max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in factors), default=0)
        assert length == longest


def test_licence_places(spark):
    rows = [(i, t) for i, t, _ in texts(MEDIUM)] + [(5000, "x under the MIT License under the mit license"), (5001, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:")]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        hits = [(k, label) for k in range(len(w)) for phrase, label in licences.BASE_PHRASES.items() if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None)
        assert r["base_labels"] == ",".join(sorted({label for _, label in hits})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert got[5001]["labels"] == "bsd" and got[5001]["score"] == pytest.approx(1.0) and got[5000]["n_base"] == 2


def test_licence_chains_cross_unknown_words(spark):
    def lines(text, width, mark):
        w = text.split()
        return "\n".join(f"{mark} {' '.join(w[i : i + width])}" for i in range(0, len(w), width))

    mit, apache = licences.TEMPLATES["mit"][0], licences.TEMPLATES["apache-2"][0]
    half = len(mit.split()) // 2
    rows = [
        (0, " ".join([*mit.split()[:half], "zzyzx", *mit.split()[half + 1 :]])),
        (1, lines(mit, 12, "dnl")), (2, lines(mit, 12, "rem")), (3, lines(apache, 4, "dnl")),
        (4, " ".join([*mit.split()[:half], *["zzyzx"] * 4, *mit.split()[half:]])),
    ]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(5)] == ["mit", "mit", "mit", "apache-2", ""]  # a gap has at most three words
    assert got[0]["score"] > 0.95 and all(got[i]["score"] == 1.0 for i in (1, 2, 3))
    assert [(s["first"], s["last"]) for s in got[1]["spans"]] == [(1, got[1]["n_words"] - 1)]


def test_audio_round_trip_and_resampling(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(1000).astype(np.float32)
    for up, down in ((1, 2), (2, 3), (3, 2)):
        h = audio._lowpass(up, down, 32)
        z = np.zeros(len(x) * up)
        z[::up] = x
        direct = np.convolve(z, h)[len(h) // 2 :][: len(z)][::down]
        got = audio.resample(x, up, down, h)
        assert np.abs(got[: len(direct)] - direct[: len(got)]).max() < 1e-4
    rows = [(i, t) for i, t, _ in texts()] + [(9000, None), (9001, texts()[0][1])]
    media = audio.store(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in audio.digests(media).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        whole = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"], r["media_bytes"]) == (len(raw), len(whole), zlib.crc32(whole[-16:]), len(whole) + 44)
        file = io.BytesIO()
        with wave.open(file, "wb") as w:
            w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000)
            w.writeframes(whole)
        assert r["payload_sha256"] == hashlib.sha256(whole).hexdigest() and r["media_sha256"] == hashlib.sha256(file.getvalue()).hexdigest()
        n_frames, active = r["feature"].split(";")[:2]
        assert r["tensors"] == -(-int(n_frames) // audio.BLOCK)
        spans = [tuple(map(int, x.split("-"))) for x in r["active_ms"].split(",") if x]
        assert [len(spans), sum(b - a for a, b in spans)] == [int(active.split(":")[0]), 16 * int(active.split(":")[1])]
    assert got[9001]["feature"] == got[rows[0][0]]["feature"]
    made = audio.write_tensors(audio.tensors(media), _folder(spark)).collect()
    table = pa.ipc.open_file(made[0]["path"].removeprefix("file://")).read_all()
    assert table.schema.field("log_mel").type == pa.fixed_shape_tensor(pa.float32(), (audio.BLOCK, audio.MELS)) and sum(m["n"] for m in made) >= len(rows)


def _folder(spark):
    from apchecks.llm.common import fresh_path

    return fresh_path(spark, "tensors")


def test_log_mel_against_a_direct_transform():
    x = np.random.default_rng(9).standard_normal(700)
    n = audio.FRAME
    basis = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hertz = lambda m: 700 * (10 ** (m / 2595) - 1)
    top = mel(4000 / 2)
    got = audio.log_mel(x.astype(np.float32))
    assert len(got) == 1 + (len(x) - n) // audio.HOP
    for i, row in enumerate(got):
        power = np.abs(basis @ (x[i * audio.HOP : i * audio.HOP + n] * window)) ** 2
        for j, value in enumerate(row):
            low, mid, high = (hertz(top * (j + s) / (audio.MELS + 1)) for s in range(3))
            energy = sum(p * max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid))) for p, f in zip(power, np.arange(n // 2 + 1) * 4000 / n))
            assert abs(value - np.log10(energy + 1e-6)) < 1e-3


def test_tensors_keep_frames():
    mel = np.random.default_rng(3).standard_normal((70, audio.MELS)).astype(np.float32)
    block, frames = audio.blocks(mel)
    kept = audio.as_tensors(block)
    assert kept.type == pa.fixed_shape_tensor(pa.float32(), (audio.BLOCK, audio.MELS)) and len(kept) == 3
    assert np.array_equal(audio.from_tensors(kept, frames), mel)


def test_search_of_repeated_query_ids(spark):
    rows = [(100, [3.0, 4.0]), (100, [1.0, 9.0]), (1, [1.0, 8.0]), (2, [3.0, 3.0]), (3, None), (None, [1.0, 1.0]), (4, [0.0, 0.0])]
    got = anisotropic.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in sorted(got, key=lambda r: r["rank"])] == [
        (100, 1, 1, 1.0), (100, 2, 2, round(40**0.5, 9)),
    ]


def test_segments_have_hysteresis():
    level = np.array([0, 0, 0, 2.0, 1.0, 1.0, 0.4, 1.0, 0, 0, 0, 0.0])
    assert audio.segments(level).tolist() == [[3, 6]]


@pytest.mark.parametrize("block_rows", [300, 8192])
def test_search_recall(spark, block_rows):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = anisotropic.nearest(e, block_rows=block_rows).toPandas()
    pdf = e.toPandas().sort_values("vec_id")
    x, ids = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy()
    hit = total = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hit, total = hit + len(set(best) & set(g.vec_id)), total + 10
        assert np.allclose(g.sort_values("rank").score, d[np.searchsorted(ids, g.sort_values("rank").vec_id)], rtol=1e-12)
    assert hit / total >= 0.9


def test_anisotropic_loss_beats_plain_assignment():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((2000, 16))
    books = anisotropic.train(x, threshold=0.5, rounds=3)
    norm = np.linalg.norm(x, axis=1)

    def loss(codes):
        r = x - np.concatenate([books.centroids[j][codes[:, j]] for j in range(8)], axis=1)
        return ((r**2).sum(axis=1) + (books.eta - 1) * ((r * x).sum(axis=1) / norm) ** 2).sum()

    assert loss(books.encode(x, rounds=2)) < loss(books.encode(x, rounds=0))


def test_grammar_contexts():
    g = toxicity.grammar()
    insult, negation, report, target, threat, other = toxicity.INSULT, toxicity.NEGATION, toxicity.REPORT, toxicity.TARGET, toxicity.THREAT, toxicity.OTHER
    score = lambda *symbols: g.score(symbols, [4.0 if s == insult else 0.0 for s in symbols])
    assert score(other, insult) == 4.0 and score(other, other) == 0.0
    assert score(negation, other, insult) < score(other, other, insult) < score(target, other, insult)
    assert score(report, other, insult) < 4.0
    assert score(threat, target) > 0 and score(threat, other) == 0.0


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    p = toxicity.score(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).toPandas()
    m = p.merge(duckdb.sql(f"select doc_id, toxic from '{folder}/labels.parquet'").df())
    m = m[m.held_out]
    raised = m[m.predicted == 1]
    assert (raised.toxic == 1).mean() > 0.9 and (m[m.toxic == 1].predicted == 1).mean() > 0.85 and p.score.between(0, 1).all()


def test_toxicity_keeps_rare_insults_whatever_the_number_of_labels(spark):
    toxic = [(i, f"well blorf{i % 7} it {'snarfle' if i < 16 else 'gribbet'} runs on", 1) for i in range(2400)]
    clean = [(10_000 + i, f"well the river{i % 7} and it runs on", 0) for i in range(4800)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in [*toxic, *clean]] + [(90_000, "so snarfle then")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in [*toxic, *clean]], "doc_id long, toxic int")
    whole = {r["doc_id"]: r["clause_score"] for r in toxicity.score(docs, labels, least_weight=2.0).collect()}
    assert whole[90_000] > 2.0
    joined = {r["doc_id"]: r["clause_score"] for r in toxicity.score(docs, labels, least_weight=2.0, max_broadcast=1).collect()}
    assert joined == whole
    clean_ids = lambda **k: sorted(r["doc_id"] for r in toxicity.keep_clean(docs, labels, least_weight=2.0, **k).collect())
    assert clean_ids(max_broadcast=1) == clean_ids()


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for name, stage in c.STAGES:
        after = stage(spark, before, SMALL)
        if name == "packing":
            pieces = after.toPandas()
            filled = pieces.groupby("sequence_id").agg(length=("length", "sum"), offset=("offset", "max"), pieces=("length", "size"))
            assert filled["length"].max() <= 2048 and pieces.groupby("sequence_id").apply(lambda g: g.sort_values("offset").eval("offset + length").iloc[-1] == g["length"].sum(), include_groups=False).all()
            assert pieces["length"].sum() == pieces[pieces["start"] == 0]["doc_tokens"].sum() and (pieces["start"] == 0).sum() == before.count()
            continue
        assert after.columns == docs.columns
        if name == "toxicity":
            scores = toxicity.score(before, spark.read.parquet(f"{SMALL}/labels.parquet")).toPandas()
            assert after.count() == (scores.predicted == 0).sum()
        if name == "near_duplicates":
            groups = parity_join.near_duplicates(before, 5, 80).toPandas()
            assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted(groups.component_id.unique())
        if name == "source_mix":
            plan = mixing.mix_plan(before).groupBy("source").agg({"taken": "sum", "target": "max"}).toPandas().set_index("source").sort_index()
            words = after.toPandas().assign(words=lambda d: d["text"].map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))).groupby("source")["words"].sum()
            assert (words == plan["sum(taken)"]).all() and (abs(words - plan["max(target)"]) <= 1).all()
        before = materialize(after, name)

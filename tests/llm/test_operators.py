"""The training-data operators against brute force on small, awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tessera.llm")
from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import chunks, decontamination, exact_dedup, langid, lm, mixing, packing, quality, registry, simhash, substrings, token_counts, toxicity  # noqa: E402
from tessera.llm.common import connected_components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, length long, fp string"
DOCS = "/root/testdata/sf0.001/documents.parquet"


def fold(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def table(spark, rows):
    """documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", None, 1.0, 2, "x") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(4)
    vocab = [("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = text(40)
    rows = [(i, text(rng.randint(1, 60)), rng.choice(["en", "fr", None])) for i in range(60)]
    rows += [(100 + i, f"{text(5)}\n{passage}  {text(i)}", "en") for i in range(12)]
    rows += [(200, None, None), (201, "", "en"), (202, " \t\n", "en"), (203, "a", "fr"), (204, "Éa\x00b <|endoftext|> ½ ß", "fr"), (205, text(9000), "en")]
    rows += [(300 + i, passage.upper(), "fr") for i in range(9)] + [(320, passage.replace(" ", " \t"), "fr"), (7, rows[7][1], rows[7][2]), (None, "nobody", None), (None, passage, "en")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, awkward):
    return table(spark, awkward).repartition(5).cache()


@pytest.fixture
def empty(spark):
    return table(spark, [])


# ---------------------------------------------------------- exact dedup ----
def test_exact_dedup(docs, awkward):
    import re

    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, _ in awkward]
    size, least = Counter(t for _, t in norm), {}
    for i, t in norm:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    want = sorted((str((i, least.get(t), size[t], i == least.get(t), hashlib.sha256(t.encode()).hexdigest())) for i, t in norm))
    for split in (None, 0, 10**9):
        got = exact_dedup.exact_dedup(docs, split).collect()
        assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got) == want


def test_exact_dedup_with_an_outlying_id(spark, monkeypatch):
    """One huge id neither empties the batch nor puts all incoming digests into one bucket."""
    monkeypatch.setattr(exact_dedup, "KEYS_PER_BUCKET", 100)
    seen, real = [], exact_dedup.build_snapshot

    def watched(rows, incoming=0):
        found = real(rows, incoming)
        seen.append((found.entries.count(), incoming, found.buckets))
        return found

    monkeypatch.setattr(exact_dedup, "build_snapshot", watched)
    got = exact_dedup.exact_dedup(table(spark, [(i, f"text {i % 900}", "en") for i in range(1200)] + [(2**60, "text 5", "en")])).collect()
    ((old, new, buckets),) = seen
    assert min(old, new) > 400 and buckets >= max(old, new) / 100
    assert sum(r.kept for r in got) == 900 and {r.keep_id for r in got if r.doc_id == 2**60} == {5}
    assert exact_dedup.exact_dedup(table(spark, [(i, f"text {i}", "en") for i in range(300)]), split_at=0).where("kept").count() == 300


def test_exact_dedup_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 60_000])
def test_fuse_filter_has_no_false_negatives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n).astype(np.uint64)
    f = exact_dedup.fuse_build(keys)
    assert exact_dedup.fuse_has(f, keys).all() or not n
    other = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    assert exact_dedup.fuse_has(f, other).mean() < (0.02 if n > 100 else 1.1)


# --------------------------------------------------------- token counts ----
def test_token_counts(docs, awkward):
    model = token_counts.load("piece_bpe_32k.model")
    want = sorted(str((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 40)) for i, t, _ in awkward)
    assert sorted(str(tuple(r)) for r in token_counts.token_counts(docs, limit=40).collect()) == want


def test_token_counts_empty(empty):
    assert token_counts.token_counts(empty).count() == 0


def test_pre_tokens_add_up():
    model, rng = token_counts.load("piece_bpe_32k.model"), random.Random(1)
    texts = ["".join(rng.choice(" \n\t\r▁ab;é<s>\x00ａ　}") for _ in range(rng.randint(0, 25))) for _ in range(500)]
    split = [token_counts.pre_tokens(t) for t in texts]
    words = sorted(set().union(*split))
    size = dict(zip(words, token_counts.lengths(model, words), strict=True))
    assert [sum(size[w] for w in s) for s in split] == [len(model.encode(t)) for t in texts]
    assert token_counts.unpack(token_counts.pack({"a b": 3, "é": 1})) == {"a b": 3, "é": 1}


# -------------------------------------------------------------- simhash ----
def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(points, linked):
    up = {p: p for p in points}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, p in enumerate(points):
        for q in points[:k]:
            if linked(p, q):
                a, b = root(p), root(q)
                up[max(a, b)] = min(a, b)
    return {p: root(p) for p in points}


def test_simhash(docs, awkward):
    got = simhash.near_dedup(docs).collect()
    prints = {t: brute_fingerprint(t) for _, t, _ in awkward}
    of = brute_components(sorted(set(prints.values())), lambda p, q: (p ^ q).bit_count() <= 2)
    least = {}
    for i, t, _ in awkward:
        r = of[prints[t]]
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    want = sorted(str((i, f"{prints[t]:016x}", least[of[prints[t]]])) for i, t, _ in awkward)
    assert sorted(str(tuple(r)) for r in got) == want


@pytest.mark.parametrize("limit", [4, 50_000])
def test_trie_join_finds_every_link(spark, limit):
    """Random families of near fingerprints, with tries small enough to be cut, too."""
    rng = random.Random(limit)
    points = set()
    for _ in range(40):
        p = rng.getrandbits(64) & (2**64 - 1 if rng.random() < 0.5 else 2**20 - 1)
        for _ in range(rng.randint(1, 12)):
            points.add(p)
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(64)
    points = sorted(points)
    want = brute_components(points, lambda p, q: (p ^ q).bit_count() <= 2)
    signed = lambda p: p - 2**64 if p >= 2**63 else p
    df = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    cc = {r.node: r.component for r in connected_components(simhash.links(df, trie_keys=limit)).collect()}
    groups = {}
    for p in points:
        groups.setdefault(want[p], set()).add(cc.get(signed(p), signed(p)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_skewed_tries_are_cut_until_all_are_small(spark, monkeypatch):
    """Fingerprints with forty leading bits in common: no pair of subtrees in a task exceeds the limit."""
    rng, limit, largest = random.Random(3), 60, []
    points = sorted({(0xABCDE12345 << 24) | rng.getrandbits(14) << rng.choice((0, 10)) for _ in range(1500)})
    signed = lambda p: p - 2**64 if p >= 2**63 else p
    real = simhash.written

    def watched(df, name):
        out = real(df, name)
        if name == "hot-tries":
            largest.append(out.agg(F.max("count")).first()[0] or 0)
        return out

    monkeypatch.setattr(simhash, "written", watched)
    df = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    cc = {r.node: r.component for r in connected_components(simhash.links(df, trie_keys=limit)).collect()}
    assert largest[-1] == 0 and len(largest) > 2
    want = brute_components(points, lambda p, q: (p ^ q).bit_count() <= 2)
    groups = {}
    for p in points:
        groups.setdefault(want[p], set()).add(cc.get(signed(p), signed(p)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_simhash_empty(empty):
    assert simhash.near_dedup(empty).count() == 0


def test_connected_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(301)} == {1000} and 5000 not in got


# ----------------------------------------------------------- substrings ----
@pytest.mark.parametrize("size", [3_000_000, 700])
def test_substrings(docs, awkward, monkeypatch, size):
    monkeypatch.setattr(chunks.chunk_store, "__defaults__", (None, size))
    seen = {}
    for i, t, _ in awkward:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            key, rank = tuple(w[k : k + 13]), 2**63 - 1 if i is None else i
            seen[key] = min(seen.get(key, rank), rank)
    want = []
    for i, t, _ in awkward:
        w, rank = (t or "").encode().split(), 2**63 - 1 if i is None else i
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if seen[tuple(w[k : k + 13])] < rank:
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append(str((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest())))
    assert sorted(str(tuple(r)) for r in substrings.substring_dedup(docs).collect()) == sorted(want)


def test_substring_spans(spark):
    words = [f"w{k}" for k in range(30)]
    df = table(spark, [(1, " ".join(words), None), (2, "x y " + " ".join(words[5:25]) + " z", None)])
    got = {r.doc_id: r for r in substrings.substring_dedup(df, spans=True).collect()}
    assert got[1].spans == [] and got[2].spans == [[2, 21]] and got[2].kept == "x y z"


def test_substrings_empty(empty):
    assert substrings.substring_dedup(empty).count() == 0


# -------------------------------------------------------------- packing ----
def test_packing(docs, awkward):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = []
    for i, t, _ in awkward:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for p, a in enumerate(range(0, len(ids), 256)):
            part = ids[a : a + 256]
            want.append(str((i, p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))))
    got = packing.best_fit_packing(docs, capacity=256).toPandas()
    rows = packing.best_fit_packing(docs, capacity=256).collect()
    assert sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 1


def test_packing_in_shards(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(rng.integers(1, 2049, 3000))], "doc_id long, length long")
    got = packing.packed(df, shard=400).toPandas()
    fill = got.groupby("sequence_id").length.sum()
    assert len(got) == 3000 and fill.max() <= 2048 and len(fill) <= 1.03 * len(packing.pack(got.length.to_numpy())) + 1


def test_local_search_empties_bins():
    sizes = np.array([6, 5, 5, 4])
    assert len(packing.local_search([[0], [1], [2], [3]], sizes, 10)) == 2
    assert packing.local_search([], np.zeros(0, np.int64), 10) == []


def test_packing_empty(empty):
    assert packing.best_fit_packing(empty).count() == 0


# ------------------------------------------------------------------- lm ----
def test_lm_base(docs, awkward):
    got = {}
    for r in lm.score(docs).collect():
        got.setdefault(r.doc_id, r)
    words = lambda t: (t or "").encode().lower().split()
    train = [words(t) for i, t, _ in awkward if i is None or fold(i, 5) != 1]
    c = Counter(w for t in train for w in t)
    c["end"] = len(train)
    n, v = sum(c.values()), len(c)
    assert lm.score(docs).count() == len(awkward)
    for i, t, _ in awkward:
        w = [*words(t), "end"]
        if i is None:
            continue
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 5) == 1, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r.score < 0 and np.isfinite(r.score)


def taught_model(lines, sample=None):
    """A model and whole tables of lines, all of which teach."""
    single = mixing.pairs(lines)
    top = mixing.common_pairs(single)
    code, total = mixing.Code(single, top, mixing.triples(lines, top)), np.zeros(2 * mixing.SLOTS, np.int64)
    for k in mixing.keys(lines, code, 0):
        np.add.at(total, k, 1)
    table, model = mixing.states(*total.reshape(-1, 2).T), mixing.untaught(code)
    model.maps = mixing.maps_from(mixing.observed(lines, code, table))
    model.weights, seen = mixing.teach(lines, model, table)
    model.refined = mixing.refined_from(seen)
    return model, table


def lines_of(n, size, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(50)]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, size))).encode() for _ in range(n)]


def test_lm_is_a_distribution():
    """The code is complete: the cost of all continuations of a context sums to one."""
    lines = [b"ab ab", b"ba", b"", b"abab"]
    model, table = taught_model(lines)
    length = model.code.length
    assert np.allclose(np.add.reduceat(0.5 ** length.astype(float), np.arange(0, len(length), mixing.SYMBOLS)), 1)
    cost = mixing.cost(lines, model, table)
    assert len(cost) == 4 and (cost > 0).all()
    assert np.allclose(cost, np.concatenate([mixing.cost([x], model, table) for x in lines]), rtol=1e-4)


def test_lm_cost_against_a_scalar_coder():
    """The same model run bit by bit, one document at a time, in plain Python."""
    import math

    lines = lines_of(12, 60, 1) + [b" ".join(lines_of(40, 90, 2)), b""]
    model, table = taught_model(lines_of(200, 60, 1))
    want = []
    for line in lines:
        found = mixing.decisions([line], model.code)
        state = [[int(table[int(v) + mixing.BASES[k]]) for v in slot] for k, slot in enumerate(found.slots)]
        sym, start, place, pair = mixing.placed([line], model.code)
        block = [int(b) for b, n in zip(mixing.block_of(place), model.code.length[pair], strict=True) for _ in range(n)]
        own, curve, bits, at = [0.0] * mixing.INPUTS, list(map(float, model.refined)), 0.0, 0
        while at < len(block):
            to = at
            grad, seen, ones = [0.0] * mixing.INPUTS, [0] * mixing.LEVELS, [0] * mixing.LEVELS
            while to < len(block) and block[to] == block[at]:
                s = [x[to] for x in state]
                x = [float(model.code.prior[found.node[to]])] + [float(model.maps[k][v]) for k, v in enumerate(s)]
                total = lambda v: float(mixing.NO[v] + mixing.YES[v])
                kind = lambda v: 0 if total(v) < 0.5 else 1 if total(v) < 3.5 else 2
                gate = 3 * kind(s[mixing.GATED[0]]) + kind(s[mixing.GATED[1]])
                dot = max(-8.0, min(8.0, sum((float(w) + o) * v for w, o, v in zip(model.weights[gate], own, x, strict=True))))
                p, y = 1 / (1 + math.exp(-dot)), int(found.bit[to])
                cell = int(dot * (mixing.LEVELS - 1.01) / 16 + mixing.LEVELS / 2)
                final = p + mixing.REFINED * (curve[cell] - p)
                bits -= math.log2(final if y else 1 - final)
                grad = [g + v * (y - p) for g, v in zip(grad, x, strict=True)]
                seen[cell] += 1
                ones[cell] += y
                to += 1
            own = [o + mixing.RATE / math.sqrt(to - at) * g for o, g in zip(own, grad, strict=True)]
            curve = [c + (1 - (1 - mixing.MAP_RATE) ** n) * (k / n - c) if n else c for c, n, k in zip(curve, seen, ones, strict=True)]
            at = to
        want.append(bits)
    assert mixing.cost(lines, model, table) == pytest.approx(want, rel=2e-3, abs=1e-2)


def test_lm_counts_by_symbol_equal_counts_by_decision():
    lines = lines_of(80, 40, 3)
    single = mixing.pairs(lines)
    top = mixing.common_pairs(single)
    code = mixing.Code(single, top, mixing.triples(lines, top))
    for grow in (0, 8):
        for k, (want, raw) in enumerate(zip(mixing.keys(lines, code, grow), mixing.raw_counts(lines, code, grow), strict=True)):
            values, counts = np.unique(raw, return_counts=True)
            if k in mixing.COMPACT:
                values, counts = lm.merged([mixing.spread(values, counts, k, code, grow)])
            distinct, many = np.unique(want, return_counts=True)
            assert (values == distinct).all() and (counts == many).all()


def test_lm_states():
    no, yes = np.meshgrid(np.arange(40), np.arange(40))
    got = mixing.states(no.ravel(), yes.ravel())
    small = (no + yes).ravel() <= mixing.EXACT
    assert (mixing.NO[got[small]] == no.ravel()[small]).all() and (mixing.YES[got[small]] == yes.ravel()[small]).all()
    assert got[~small].min() >= mixing.FIRST_LARGE
    assert int(mixing.states(np.array([10**12]), np.array([0]))[0]) >= mixing.FIRST_LARGE  # beyond 32 bits
    counts = np.array([1, 2**32 - 1], np.uint32)
    assert (lm.unpack_counts(lm.pack_counts(counts)) == counts).all()


def test_lm_leaves_a_line_out_of_its_own_lesson():
    lines = [b"unheard words", b"common text", b"common text"]
    model, table = taught_model(lines)
    found = mixing.decisions(lines, model.code)
    left = mixing.without_own(found, mixing.looked_up(found, table, 0))
    assert (mixing.NO + mixing.YES)[left[2][found.owner == 0]].sum() < found.owner.tolist().count(0)
    assert (mixing.NO + mixing.YES)[left[2][found.owner == 1]].min() >= 1


def test_lm_lessons_side_by_side_are_lessons_apart():
    model, table = taught_model(lines_of(300, 60, 6))
    classes = [lines_of(n, 90, seed) for n, seed in ((40, 1), (0, 2), (150, 3), (1, 4))]
    weights, seen = mixing.teach_apart(classes, model, table)
    apart = [mixing.teach(lines, model, table) for lines in classes]
    assert np.allclose(weights, [w for w, _ in apart], atol=1e-5) and seen.sum() == sum(s.sum() for _, s in apart)
    assert len({w.tobytes() for w in weights}) == 4


@pytest.mark.parametrize("grow", [0, 9])
def test_lm_nodes_of_a_context_share_lines_but_no_slot(grow):
    kind, node = mixing.hash_type(grow), np.arange(3 * mixing.NODES)
    for h in (0, 1, 0x1234567):
        context = np.full(1, h, kind) * mixing.factor(kind)
        slot = mixing.slots_of(context, np.zeros(len(node), np.int64), *mixing.turned(node, kind), 20 + grow)
        line = slot.reshape(-1, mixing.LINE) // kind(mixing.LINE)
        assert (line == line[:, :1]).all() and all(len(set(x)) == mixing.LINE for x in slot.reshape(-1, mixing.LINE).tolist())
        assert len(set(line[:, 0].tolist())) > 1


def test_lm_learning_pays_on_held_out_text():
    """Gated weights and maps learned, then online updates: each lowers the cost of unseen lines."""
    text = lines_of(900, 60, 5)
    train, rest = text[:800], text[800:]
    model, table = taught_model(train)
    plain = mixing.untaught(model.code)
    assert mixing.cost(rest, model, table).sum() < mixing.cost(rest, plain, table).sum()


def test_lm_empty(empty):
    assert lm.score(empty).count() == 0


def test_lm_learns(spark):
    import pandas as pd

    got: pd.DataFrame = lm.score(spark.read.parquet(DOCS)).toPandas()
    assert got[~got.held_out].score.sum() > got[~got.held_out].base_score.sum()
    assert got[got.held_out].score.sum() > got[got.held_out].base_score.sum()


def test_lm_tables_grow_with_the_training_text(spark, monkeypatch):
    """Larger tables keep contexts apart, and asking by slice gives the scores of whole tables."""
    df = spark.read.parquet(DOCS)
    assert [mixing.doublings(n) for n in (0, 100_000_000, 100_000_001, 24_000_000_000)] == [0, 0, 1, 8]
    scores = lambda: {r.doc_id: r.score for r in lm.score(df).collect()}
    base = scores()
    monkeypatch.setattr(mixing, "BASE_BYTES", 100_000)
    grown = scores()
    monkeypatch.setattr(lm, "BROADCAST_SLOTS", 0)
    asked = scores()
    assert grown == pytest.approx(asked) and grown != base
    for grow in (0, 3, 7, 9):  # with hashes of 32 and of 64 bits
        lines = [b"some text some more", b"", b"text"]
        single = mixing.pairs(lines)
        top = mixing.common_pairs(single)
        slots = mixing.decisions(lines, mixing.Code(single, top, mixing.triples(lines, top)), grow=grow).slots
        assert all(int(s.max()) < 1 << log2 + grow for s, (_, log2) in zip(slots, mixing.CONTEXTS, strict=True))


@pytest.mark.parametrize("broadcast", [True, False])
def test_lm_teaches_on_all_training_rows(spark, broadcast):
    """Maps, gated weights and refinement come from every training line, whether tables are broadcast or asked for."""
    store = lm.chunk_store(spark.read.parquet(DOCS), True, ~lm.held_out("doc_id", 5, 1))
    code, *_ = lm.training_code(store)
    tables = lm.written(lm.training_tables(store, code, 0), "tables")
    table = lm.whole(tables, 0)
    got = lm.taught(lm.with_slots(store, tables, code, 0, broadcast), code, table if broadcast else None, 0)
    want, seen, weights, size = mixing.untaught(code), 0, 0, 0
    taught = []
    for r in store.collect():
        lines = [x for x, f in zip(lm.unpack_lines(r.lines, r.n), r.flags, strict=True) if f]
        taught += [lines[a:b] for a, b in lm.groups(lines)]
    want.maps = mixing.maps_from(sum(mixing.observed(x, code, table) for x in taught))
    assert np.allclose(got.maps, want.maps)
    for x in taught:
        w, s = mixing.teach(x, want, table)
        n = sum(map(len, x)) + len(x)
        weights, seen, size = weights + w * n, seen + s, size + n
    assert np.allclose(got.weights, weights / size, atol=1e-5) and np.allclose(got.refined, mixing.refined_from(seen), atol=1e-5)


def test_lm_leaves_out_exactly_what_a_line_counted():
    lines = lines_of(60, 50, 8)
    model, table = taught_model(lines)
    found = mixing.decisions(lines, model.code)
    state = mixing.looked_up(found, table, 0)
    for slot, s, left in zip(found.slots, state, mixing.without_own(found, state), strict=True):
        for k in range(0, len(s), 97):
            own = (found.owner == found.owner[k]) & (slot == slot[k])
            yes = int(found.bit[own].sum())
            want = s[k] if s[k] >= mixing.FIRST_LARGE else mixing.states(np.array([max(mixing.NO[s[k]] - (int(own.sum()) - yes), 0)]).astype(int), np.array([max(mixing.YES[s[k]] - yes, 0)]).astype(int))[0]
            assert left[k] == want


def test_lm_equal_slots_of_a_line_stand_together(monkeypatch):
    """Whether or not owner, slot and place fit one number."""
    rng = np.random.default_rng(3)
    for top in (1 << 22, 1 << 40, 1 << 62):
        owner, slot = rng.integers(0, 50, 3000).astype(np.int32), rng.choice(rng.integers(0, top, 40), 3000).astype(np.uint64)
        where, first = mixing.together(owner, slot)
        got = [list(zip(owner[where[a:b]].tolist(), slot[where[a:b]].tolist(), strict=True)) for a, b in zip(first, [*first[1:], len(where)], strict=True)]
        assert sorted(where.tolist()) == list(range(3000)) and all(len(set(x)) == 1 for x in got)
        assert len(got) == len({x[0] for x in got}) == len(set(zip(owner.tolist(), slot.tolist(), strict=True)))


def test_lm_merged_counts():
    rng = np.random.default_rng(4)
    for kind, most in ((np.uint32, 1 << 31), (np.uint64, 1 << 62)):
        keys = rng.choice(rng.integers(0, most, 50), 2000).astype(kind)
        counts = rng.integers(1, 1 << 20, 2000).astype(np.uint32)
        got, sums = lm.merged([(keys[:900], counts[:900]), (keys[900:], counts[900:])])
        assert got.dtype == kind and got.tolist() == sorted(set(keys.tolist()))
        assert sums.tolist() == [int(counts[keys == k].sum()) for k in got]


def test_lm_lesson_against_plain_steps():
    """Gated weights and refinement step by step."""
    lines = lines_of(60, 200, 6)
    model, table = taught_model(lines)
    got, seen = mixing.teach(lines, model, table)
    found = mixing.decisions(lines, model.code)
    x, gate = mixing.inputs(found, mixing.without_own(found, mixing.looked_up(found, table, 0)), model)
    x, weights, cells = np.stack(x, 1).astype(float), model.weights.astype(float), np.zeros((mixing.LEVELS, 2))
    for epoch in range(mixing.EPOCHS):
        for a in range(0, len(gate), mixing.LESSON):
            g, y, each = gate[a : a + mixing.LESSON], found.bit[a : a + mixing.LESSON].astype(float), x[a : a + mixing.LESSON]
            dot = np.clip((weights[g] * each).sum(axis=1), -8, 8)
            for k in set(g.tolist()):
                weights[k] += mixing.LEARN_RATE / np.sqrt((g == k).sum()) / (1 + epoch) * ((y - 1 / (1 + np.exp(-dot)))[g == k] @ each[g == k])
            if epoch == mixing.EPOCHS - 1:
                np.add.at(cells, (dot * ((mixing.LEVELS - 1.01) / 16) + mixing.LEVELS / 2).astype(int), np.stack([np.ones(len(y)), y], 1))
    assert np.allclose(got, weights, atol=1e-3) and seen[:, 0].sum() == len(gate)
    assert np.abs(seen - cells).sum() <= 2e-3 * cells.sum() + 4


# ------------------------------------------------------------ decontamination ----
def test_decontamination(spark):
    rng = random.Random(2)
    vocab = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("ama", "oro", "ine", "usta", "elko", "irda")]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(rng.randint(15, 60)).capitalize() + ".") for k in range(30)] + [(90, None), (91, "!!")]
    rows, want = [(i, text(rng.randint(0, 300)), "en") for i in range(80)] + [(80, None, None), (81, "", "en")], set()
    for i in range(100, 130):
        item, words = items[i - 100][0], items[i - 100][1].split()
        noisy = [w if rng.random() > 0.1 else rng.choice(vocab) for w in words] if i % 2 else words
        rows.append((i, " ".join([text(rng.randint(0, 120)), *noisy, text(rng.randint(0, 90))]), "en"))
        want.add((i, item))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, rows)
    got = {(r.doc_id, r.item_id) for r in decontamination.decontaminate(docs, bench).collect()}
    assert len(want - got) <= 2 and not got - want
    assert decontamination.decontaminate(table(spark, []), bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == 0


def accepted(p, words, idf):
    """Brute force: whether any region of the words, one for each place, passes the operator's own LCS and answer checks."""
    rare = sorted({(-idf[int(f)], w) for f, w in zip(decontamination.features([" ".join(p)])[0], p, strict=True)})
    answers, wide, n = {w for _, w in rare[: max(1, len(rare) // 3)]}, max(2, len(p) // 4), len(p)
    for a in range(max(1, len(words) - n + 1)):
        region = words[max(0, a - wide) : a + n + wide]
        if len(answers.intersection(region)) >= decontamination.ANSWER * len(answers) and decontamination.common_subsequence(p, region) >= (1.0 if n < decontamination.SHORT else decontamination.COMMON) * n:
            return True
    return False


@pytest.mark.parametrize("replaced", [0.1, 0.2, 0.3])
def test_recall_of_paraphrases_against_brute_force(spark, replaced):
    """Items with words replaced, inserted and swapped, planted in documents: of what LCS over all regions accepts, nine in ten are found."""
    rng = random.Random(int(replaced * 10))
    docs = spark.read.parquet(DOCS).select("doc_id", "text")
    vocab = sorted({w for r in docs.limit(60).collect() for w in decontamination.words_of(r.text)})
    items = [(k, " ".join(decontamination.words_of(r.text)[: rng.choice([9, 14, 30, 80])])) for k, r in enumerate(spark.read.parquet(DOCS.replace("documents", "benchmark")).orderBy("item_id").collect())]
    rows = []
    for k, text in items:
        words = [w if rng.random() > replaced else rng.choice(vocab) for w in text.split()]
        if k % 3 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(vocab))
        if k % 3 == 1:
            at = rng.randrange(len(words) - 1)
            words[at : at + 2] = words[at + 1], words[at]
        rows.append((10**6 + k, " ".join([rng.choice(vocab) for _ in range(rng.randint(0, 200))] + words + [rng.choice(vocab) for _ in range(rng.randint(0, 200))])))
    both = docs.union(spark.createDataFrame(rows, docs.schema))
    got = {(r.doc_id, r.item_id) for r in decontamination.decontaminate(both, spark.createDataFrame(items, "item_id long, text string")).collect()}
    df, n = decontamination.document_frequencies(both)
    idf = np.log((n + 2) / (df + 1)) + 0.1
    want = {(i, k) for (k, text), (i, t) in zip(items, rows, strict=True) if accepted(text.split(), t.split(), idf)}
    assert len(want) >= 25 and len(got & want) >= 0.9 * len(want)
    assert all(k == i - 10**6 for i, k in got if i >= 10**6)


def searcher(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text")
    bench = spark.read.parquet(DOCS.replace("documents", "benchmark"))
    items = decontamination.passages([(r.item_id, r.text) for r in bench.collect()])
    return decontamination.Searcher(items, *decontamination.latent_space(docs, decontamination.passage_table(bench))), [r.text for r in docs.collect()]


def test_words_are_compared_only_where_the_answer_check_may_succeed(spark, monkeypatch):
    """Nearly all windows of unrelated text fail the answer check; hashes tell so without losing a find."""
    search, texts = searcher(spark)
    asked, decide = [], search._decide
    monkeypatch.setattr(search, "_decide", lambda words, q, *rest: (asked.append((words, q)), decide(words, q, *rest)))
    got = search.found(texts)
    near = sum(len(t) for at in range(0, len(texts), 50) for t, *_ in search.candidates(decontamination.features(texts[at : at + 50])))
    assert any(got) and len(asked) < near / 3
    search.enough[:] = 0  # every candidate is asked
    assert search.found(texts) == got and len(asked) > near


def test_windows_against_sums_word_by_word(spark):
    search, texts = searcher(spark)
    feats = decontamination.features([texts[0], None, "one", *texts[1:40]])
    for length, which, query in search.classes:
        got = {(int(t), int(q), int(a), int(b)): c for x in search.candidates(feats) for t, q, a, b, c in zip(*x, strict=True) if q in which}
        want = {}
        for t, f in enumerate(feats):
            last, step = -(-len(f) // 2) * 2, max(1, length // 8) * 2
            for a in sorted({*range(0, max(last - length, 0), step), max(last - length, 0)}):
                v = search.vectors[f[a : a + length]].astype(float).sum(axis=0)
                for q, c in zip(which.tolist(), (v / max(np.linalg.norm(v), 1e-9)) @ query, strict=True):
                    want[t, q, a, min(a + length, len(f))] = c
        assert got.keys() <= want.keys() and all(abs(want[k] - c) < 1e-4 for k, c in got.items())
        assert all(k in got for k, c in want.items() if c >= decontamination.COSINE + 1e-4)


def test_words_and_their_features():
    texts = ["A b_c d1, É'x", None, "", "...", "naïve-naïve ß", "x" * 50, "\ud800 lone", " lead trail "]
    for t, f in zip(texts, decontamination.features(texts), strict=True):
        words = decontamination.words_of(t)
        assert len(f) == len(words) and all(decontamination.features([w])[0][0] == k for w, k in zip(words, f.tolist(), strict=True))


def test_features_in_blocks(monkeypatch):
    texts = ["one two three " * 40, "w" * 900 + " tail", "é" * 30]
    whole = decontamination.features(texts)
    monkeypatch.setattr(decontamination, "HASHED", 64)
    assert all((a == b).all() for a, b in zip(whole, decontamination.features(texts), strict=True))


def test_decontamination_of_awkward_rows(spark, monkeypatch):
    """Null item ids, repeated items and rows, and a text far longer than one block."""
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 500)
    rng = random.Random(8)
    vocab = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("ama", "oro", "ine", "usta", "elko", "irda")]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    secret, other = text(40), text(25)
    bench = spark.createDataFrame([(None, secret), (None, secret), (5, other), (5, other)], "item_id long, text string")
    long = f"{text(3000)} {secret} {text(2000)} {other}"
    rows = [(i, text(80), "en") for i in range(40)] + [(50, long, "en"), (50, long, "en"), (None, other, None), (60, None, None)]
    got = sorted((str(r.doc_id), str(r.item_id)) for r in decontamination.decontaminate(table(spark, rows), bench).collect())
    assert got == sorted([("50", "None"), ("50", "None"), ("50", "5"), ("50", "5"), ("None", "5")])
    kept = decontamination.clean(table(spark, rows), bench)
    assert kept.columns == table(spark, rows).columns and kept.count() == 41


def test_space_is_fitted_on_all_blocks_of_the_benchmark(spark, monkeypatch):
    """What is found does not depend on how the benchmark is cut into blocks."""
    docs, bench = spark.read.parquet(DOCS), spark.read.parquet(DOCS.replace("documents", "benchmark"))
    found = lambda: sorted((str(r.doc_id), str(r.item_id), round(r.cosine, 3)) for r in decontamination.decontaminate(docs, bench).collect())
    whole = found()
    monkeypatch.setattr(decontamination, "ITEMS", 20)
    assert found() == whole


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontamination.common_subsequence(a, b) == best[-1][-1]


# ---------------------------------------------------------- classifiers ----
def test_language_id(spark, docs, awkward):
    real = spark.read.parquet(DOCS)
    got = langid.language_id(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()
    odd = langid.language_id(docs).toPandas()
    assert len(odd) == len(awkward)
    assert set(odd[odd.doc_id.isin([200, 201, 202])].lang_pred) == {"und"}
    assert set(langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).toPandas().lang_pred) == {"und"}
    assert langid.language_id(docs.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [0, 10**9])
def test_automaton_follows_every_substring(monkeypatch, dense):
    monkeypatch.setattr(langid, "DENSE_BYTES", dense)
    codes = np.array([1, 2, 1, 1, 2, 3, 1, 2, 1]) + langid.UNSEEN
    one = langid.Automaton(codes, 8)
    inside = {tuple(codes[a:b].tolist()) for a in range(9) for b in range(a + 1, 10)}
    for word in [tuple((np.random.default_rng(k).integers(1, 4, 4) + langid.UNSEEN).tolist()) for k in range(60)]:
        state, broke = np.zeros(1, np.int64), False
        for c in word:
            state = one.step(state, np.array([c]))
            broke |= bool(state[0] >> 40)
            state &= langid.BROKEN - 1
        assert broke == (word not in inside)


def test_phrases_against_a_greedy_parse():
    """Longest matches found by searching the training text, segment by segment."""
    rng = random.Random(6)
    text = lambda n, letters: "".join(rng.choice(letters + " ") for _ in range(n))
    model = (("a", text(700, "abcdé")), ("b", text(700, "cdexyz")))
    texts = ["", None, "123", text(1300, "abcdexyzq"), text(60, "abcd"), "qq q", model[0][1][40:300]]
    count, _, lettered = langid.phrases(texts, model)
    plain = lambda t: re.sub(r"[^a-zé]+", " ", (t or "").lower())
    for t, row, ok in zip(texts, count, lettered, strict=True):
        assert ok == bool(re.search("[a-zé]", plain(t)))
        for k, (_, learned) in enumerate(model):
            source, phrases = plain(learned), 0
            for a in range(0, len(plain(t)), langid.SEGMENT):
                part, at = plain(t)[a : a + langid.SEGMENT], 0
                phrases += 1
                while at < len(part):
                    n = 1 if part[at] in source else 0
                    while n and at + n < len(part) and part[at : at + n + 1] in source:
                        n += 1
                    at += n
                    if at < len(part):  # the character that breaks a match starts the next
                        phrases += 1
                        if n == 0:
                            at += 1
            assert abs(row[k] - phrases) <= sum(x not in source for x in plain(t)) + 1


def test_language_id_of_large_alphabets(spark):
    """Languages of six hundred letters each, none shared, beside a Latin one."""
    rng, rows = random.Random(9), []
    alphabets = {"en": "etaoinshr", **{f"x{k}": "".join(chr(0x4E00 + 600 * k + i) for i in range(600)) for k in range(3)}}
    for i in range(240):
        lang = rng.choice(sorted(alphabets))
        words = ["".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(1, 5))) for _ in range(200)]
        rows.append((i, " ".join(rng.choice(words) for _ in range(60)), lang))
    got = langid.language_id(table(spark, rows)).toPandas().set_index("doc_id")
    assert np.mean([got.lang_pred[i] == lang for i, _, lang in rows if got.held_out[i]]) >= 0.95


def test_language_id_ties_and_very_long_texts():
    model = (("a", "one two three"), ("b", "one two three"))
    names, scores = langid.predict(["one two", "one two three " * 20_000], model)
    assert names == ["a", "a"] and scores == pytest.approx([0.5, 0.5])


@pytest.mark.parametrize(("operator", "label"), [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_classifiers_run_on_awkward_rows(spark, docs, awkward, operator, label):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = operator(docs, labels).toPandas()
    assert len(got) == len(awkward) and got.score.between(0, 1).all() and got.predicted.isin([0, 1]).all()
    assert operator(docs, labels.limit(0)).count() == len(awkward)
    assert operator(docs.limit(0), labels).count() == 0


def test_classifiers_learn(spark):
    base = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for operator, label, least in ((toxicity.toxicity, "toxic", 0.95), (quality.quality, "quality", 0.97)):
        got = operator(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
        assert (got.predicted == got[label]).mean() >= least


def test_toxicity_scores_against_a_scalar_sum():
    """Every word of a text once, every n-gram of it, one at a time."""
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=toxicity.SLOTS), -0.3)

    def slot(gram):
        h = len(gram)
        for byte in gram:
            h = ((h ^ byte) * 0x01000193) % 2**32
        return (((h ^ (h >> 15)) * 0x2C1B3C6D) % 2**32) >> 14

    texts = ["Some WORDS, some more words", "", None, "été 42 x", "a" * 3000 + " tail"]
    want = []
    for t in texts:
        words = {b"<" + w.encode() + b">" for w in re.findall(r"[^\W\d_]+", (t or "").lower())}
        want.append(-0.3 + sum(model.weight[slot(w[i : i + n])] for w in words for n in toxicity.ORDERS for i in range(len(w) - n + 1)))
    assert model.margins(texts) == pytest.approx(want)
    assert model.margins(texts[:1] * 2 + texts[3:4]) == pytest.approx([want[0], want[0], want[3]])


def test_toxicity_fit_finds_the_weights_of_a_small_problem():
    """Against plain gradient descent on the same weighted loss."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (200, 4))
    y = (x @ np.array([1.0, -1.0, 0.5, 0.0]) + rng.normal(size=200) > 1).astype(float)
    ratio = np.array([1.0, 0.5, 2.0, 1.0])
    w, b = toxicity.fit([(np.flatnonzero(r), r[r > 0]) for r in x], y, ratio)
    value, each = x * ratio, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    loss = lambda w, b: -(each * np.log(np.where(y == 1, 1 / (1 + np.exp(-(value @ w + b))), 1 / (1 + np.exp(value @ w + b))))).sum() + toxicity.RIDGE / 2 * (w @ w)
    v, c = np.zeros(4), 0.0
    for _ in range(20_000):
        err = (1 / (1 + np.exp(-(value @ v + c))) - y) * each
        v, c = v - 0.2 * (value.T @ err + toxicity.RIDGE * v), c - 0.2 * err.sum()
    assert loss(w, b) < loss(v, c) + 2e-3


def test_toxicity_recall_on_held_out_documents(spark):
    base = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    docs = spark.read.parquet(f"{base}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").toPandas()
    toxic = got.toxic == 1
    assert got[toxic].predicted.mean() >= 0.88 and got[got.predicted == 1].toxic.mean() >= 0.97


def test_trees_against_a_scalar_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, len(quality.STATISTICS))).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    forest = quality.grow(x, y)
    for row in x[:40]:
        total = forest.base
        for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        assert forest.margin(row[None])[0] == pytest.approx(total)
    assert (forest.score(x).round() == y).mean() > 0.95


def test_first_split_is_the_best_of_all(monkeypatch):
    """Every statistic and every cut tried one by one."""
    monkeypatch.setattr(quality, "TREES", 1)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, len(quality.STATISTICS))).astype(np.float32)
    y = (x[:, 5] + 0.3 * rng.normal(size=300) > 0.4).astype(float)
    forest, p = quality.grow(x, y), y.mean()
    g, h, best = p - y, np.full(300, p * (1 - p)), (0, None)
    for f in range(x.shape[1]):
        for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1], method="lower")):
            left = x[:, f] <= c
            if min(left.sum(), (~left).sum()) >= quality.LEAF_ROWS:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + quality.RIDGE) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + quality.RIDGE)
                best = max(best, (gain, (f, float(c))), key=lambda b: b[0])
    assert (int(forest.feature[0, 0]), float(forest.cut[0, 0])) == pytest.approx(best[1])


def test_classifiers_on_very_long_texts_and_ties(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = [(i, "bad words here" if i % 2 else "good text there", "en") for i in range(60)] + [(100, "word " * 200_000, "en"), (101, "word " * 200_000, "en")]
    for operator, label, limit in ((toxicity.toxicity, "toxic", toxicity.THRESHOLD), (quality.quality, "quality", quality.THRESHOLD)):
        got = operator(table(spark, rows), labels.select("doc_id", label)).toPandas().set_index("doc_id")
        assert got.score[100] == got.score[101] and ((got.score >= limit).astype(int) == got.predicted).all()


def test_registry():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.queries())
    assert numbers == list(range(1, 11)) and set(registry.oracle_sql()) <= set(registry.queries())

"""Operators on hard small cases, against plain versions of the same definitions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from runlens.llm import bpe, exact_dedup, html_text, language, packing, pieces, pitman_yor, quality_rules, range_coder, simhash, token_counts, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words int, n int, key string"


def cases():
    rng = random.Random(8)
    line = " ".join(rng.choice("alpha beta gamma delta epsilon".split()) + str(rng.randint(0, 40)) for _ in range(60))
    rows = [None, "", " \n\t ", "one", "A b C", "日本語 テスト", line, line, line.upper(), line + " tail", line.replace(" ", "  "), "x" * 5000, "\n".join(["same line here"] * 8), "don't we'll <|endoftext|> it's", "a b c d e " * 400]
    rows += [" ".join(rng.choice("lorem ipsum dolor sit amet consetetur".split()) for _ in range(rng.randint(1, 300))) for _ in range(30)]
    return [(k if k != 5 else None, t, "en" if k % 3 else None, None, 1, 2, 3, "k") for k, t in enumerate(rows)] + [(6, line, "en", "s", 1, 2, 3, "k")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((x is None, x) for x in r)


def test_exact_dedup(docs):
    groups = collections.defaultdict(list)
    for d, t, *_ in cases():
        groups["".join(WORD.findall(t or ""))].append((-len(t or ""), d is None, d))
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(cases())
    digest = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[2], len(v)) for k, v in groups.items()}
    assert all(digest[r.text_sha256] == (r.keep_id, r.group_size) for r in got)
    assert sum(r.kept for r in got) == len(groups) == exact_dedup.keep_first(docs).count()


def test_quality_rules(docs):
    want = []
    for d, t, *_ in cases():
        w = WORD.findall(t or "")
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)))
    ledger = quality_rules.rule_ledger(docs)
    got = [tuple(r) for r in ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    verdict = quality_rules.apply_policy(ledger).collect()
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in verdict)
    by = {(r.policy, r.rule): r for r in quality_rules.ablations(ledger).collect()}
    assert by[2, "few_words"].kept == sum(r.kept for r in verdict)
    assert by[2, "few_words"].kept_without_rule == sum(r.fail_bits & ~1 & quality_rules.mask(2) == 0 for r in verdict)
    passing = quality_rules.keep_passing(docs)
    assert passing.columns == docs.columns and passing.count() == sum(r.kept for r in verdict)


def test_simhash(docs):
    rows = cases()
    prints = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints.append(sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)))
    up = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    up[a] = up[b] = min(up[a], up[b])
    least = {u: min((rows[k][0] for k in range(len(rows)) if up[k] == u and rows[k][0] is not None), default=None) for u in up}
    want = [(rows[k][0], f"{prints[k]:016x}", least[up[k]]) for k in range(len(rows))]
    for hot in (100_000, 3):
        assert sorted((tuple(r) for r in simhash.simhash_groups(docs, hot=hot).collect()), key=key) == sorted(want, key=key)


def test_links_in_dense_groups():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 3, np.int64).astype(np.uint64)
    words = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, (400, 3)).astype(np.uint64)).sum(axis=1, dtype=np.uint64) for b in base]))
    words = words[np.argsort(simhash.gray_rank(words))]
    got = simhash.link(words, np.zeros(len(words), np.int64), queries=64)
    near = np.bitwise_count(words[:, None] ^ words[None, :]) <= 4
    want = np.arange(len(words))
    for _ in words:
        new = np.where(near, want[None, :], len(words)).min(axis=1)
        if np.array_equal(new, want):
            break
        want = new
    assert np.array_equal(got, want)


def test_bpe_equals_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path("word_bpe_49k.json"))
    got = sorted((tuple(r) for r in bpe.bpe_encode(docs, with_ids=False).collect()), key=key)
    want = []
    for d, t, *_ in cases():
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=key)


def library_ids(text, end):
    encoder = tokens.byte_encoder(tokens.vocabulary_path())
    return np.array([*encoder.library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(docs):
    got = packing.pack(docs, size=64).toPandas()
    want = collections.Counter()
    for d, t, *_ in cases():
        ids = library_ids(t, 0)
        first = len(ids) % 64 or 64
        for p, a in enumerate([0, *range(first, len(ids), 64)]):
            n = first if p == 0 else 64
            want[str(d), p, a, n, zlib.crc32(ids[a : a + n])] += 1
    assert want == collections.Counter((str(None if r.doc_id != r.doc_id else int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    total, sequences = 0, 0
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.cumsum(s.length) - s.length).all() and s.length.sum() <= 64
        total, sequences = total + s.length.sum(), sequences + 1
    assert sequences <= 1.1 * total / 64 + 1


def plan_of(counts, size):
    plan, held = packing.plan(counts, size)
    cover = np.zeros(size + 1, np.int64)
    for pattern, n in plan:
        assert sum(l * k for l, k in pattern) <= size
        for l, k in pattern:
            cover[l] += k * n
    assert np.array_equal(cover, counts)
    return sum(n for _, n in plan), held


def test_plan_covers_every_length():
    counts = np.zeros(65, np.int64)
    counts[1:64] = np.random.default_rng(2).integers(0, 5000, 63) // np.arange(1, 64) * 8  # few long ones, so full sequences exist
    n, held = plan_of(counts, 64)
    total = (counts * np.arange(65)).sum()
    assert n <= 1.005 * total / 64 + 1 and held >= 0.9 * total
    uniform = np.zeros(65, np.int64)
    uniform[1:64] = np.random.default_rng(2).integers(0, 5000, 63)
    assert plan_of(uniform, 64)[0] <= 1.005 * sum(n for _, n in packing.best_fit(uniform, 64)) + 1
    for few in ({10: 1000}, {64: 3}, {33: 7, 31: 7}, {}):
        counts = np.zeros(65, np.int64)
        counts[list(few)] = list(few.values())
        plan_of(counts, 64)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_programs_patterns_hold_most_tokens(sf):
    import pathlib

    import pyarrow.parquet as pq

    folder = pathlib.Path("/root/testdata") / sf / "documents.parquet"
    if not folder.exists():
        pytest.skip("the given tables are absent")
    encoder, size = tokens.byte_encoder(tokens.vocabulary_path()), 2048
    counts = np.zeros(size + 1, np.int64)
    for ids in encoder.batch([t or "" for t in pq.read_table(folder, columns=["text"])["text"].to_pylist()]):
        for _, n in packing.pieces_of(len(ids) + 1, size):
            counts[n] += 1
    counts[size] = 0
    solution = packing.solve(counts, size)
    assert solution.bound <= solution.value <= 1.03 * solution.bound  # the duality gap
    n, held = plan_of(counts, size)
    assert held >= 0.9 * (counts * np.arange(size + 1)).sum()
    assert n <= 1.001 * solution.bound + 1


def brute_bound(counts, size):
    """Least number of sequences of a few pieces, by trying all."""
    pieces_ = [l for l in range(size, 0, -1) for _ in range(int(counts[l]))]

    def fits(k, rooms):
        return k == len(pieces_) or any(fits(k + 1, [*rooms[:i], r - pieces_[k], *rooms[i + 1 :]]) for i, r in enumerate(rooms) if r >= pieces_[k])

    return next(n for n in range(len(pieces_) + 1) if fits(0, [size] * n))


def test_bound_is_below_the_best_packing():
    rng = np.random.default_rng(5)
    for _ in range(15):
        counts = np.bincount(rng.integers(1, 12, 8), minlength=13)
        best = brute_bound(counts, 12)
        solution = packing.solve(counts, 12)
        assert solution.bound <= best + 1e-9 and best <= plan_of(counts, 12)[0] <= best + 1


def test_token_counts(docs):
    encoder = tokens.byte_encoder(tokens.vocabulary_path())
    got = collections.defaultdict(list)
    for r in token_counts.token_counts(docs, rule="first").collect():
        got[r.doc_id].append(r)
    for d, t, *_ in cases():
        if d == 6:
            continue
        t = t or ""
        rows = sorted(got[d], key=lambda r: r.section)
        lines = t.split("\n")
        starts = np.cumsum([0, *(len(x) + 1 for x in lines)])[: len(rows)]
        assert [r.start for r in rows] == starts.tolist() and sum(r.n_chars for r in rows) == len(t)
        at = [a for a, _ in encoder.library.encode(t, add_special_tokens=False).offsets]
        want = np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(rows)) if at else np.zeros(len(rows))
        assert [r.n_tokens for r in rows] == want.tolist()


def test_pieces_with_equal_hashes_keep_their_own_ids():
    words = ["".join("ab"[(k.bit_count() + flip) % 2] for k in range(2048)) for flip in (0, 1)]  # no hash modulo 2**64 tells these apart
    byte, word = tokens.byte_encoder(tokens.vocabulary_path()), bpe.word_encoder(tokens.vocabulary_path("word_bpe_49k.json"))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path("word_bpe_49k.json"))
    for texts in ([words[0], words[1]], [" ".join(words * 2)], words[::-1]):
        for t, a, b in zip(texts, byte.batch(texts), word.batch(texts)):
            assert a.tolist() == byte.library.encode(t, add_special_tokens=False).ids
            assert b.tolist() == library.encode(t, add_special_tokens=False).ids


def test_pools_that_are_full_start_anew():
    table = pieces.PieceTable(lambda x: (np.array([ord(c) for t in x for c in t], np.uint32), np.array([len(t) for t in x])), slots=64, pool=40)
    rng = random.Random(2)
    splitter = pieces.Splitter(keep_space=True)
    for _ in range(60):
        text = " ".join("".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 12)))
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        start, end = splitter.split(codes, np.array([0]))
        assert "".join(map(chr, pieces.spread(*table.look_up(codes, text, start, end)))) == text


def test_majority_goes_to_the_earlier_of_equal_sections():
    section, crossing = token_counts.attribute(np.array([0, 2, 5]), np.array([2, 6, 9]), np.array([0, 4, 6]), "majority")
    assert section.tolist() == [0, 0, 2] and crossing.tolist() == [False, True, True]


def test_token_files(docs, tmp_path):
    got = [tuple(r)[:4] for r in range_coder.round_trip(docs, folder=str(tmp_path)).collect()]
    want, at = [], 0
    by_start = sorted(got, key=lambda r: r[1])
    for (d, t, *_), r in zip(sorted(cases(), key=lambda c: (c[0] is not None, c[0] or 0)), by_start):
        ids = library_ids(t, 2)
        want.append((d, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert by_start == want  # the two rows of one identifier have equal texts


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for n in (1, 2, 63, 65, 129, 5000):
        for ids in (rng.integers(0, 300, n), np.full(n, 9), rng.zipf(1.4, n) % 300):
            assert np.array_equal(range_coder.decode_block(range_coder.encode_block(ids.astype(np.uint32), 300), n, 300), ids)
    prose = rng.integers(0, 40, (300, 6)).repeat(20, axis=0).ravel().astype(np.uint32)
    assert 8 * len(range_coder.encode_block(prose, 300)) < 5.5 * len(prose)


def test_token_files_keep_text_identifiers(spark, tmp_path):
    rows = [("\0", "a"), (None, "b"), ("", "c"), ("z", "d e f")]
    out = range_coder.round_trip(spark.createDataFrame(rows, "doc_id string, text string"), folder=str(tmp_path)).collect()
    assert {(r.doc_id, tuple(r.ids)) for r in out} == {(d, tuple(library_ids(t, 2).tolist())) for d, t in rows}


def test_damaged_blocks_are_found():
    raw = bytearray(range_coder.write_stream(np.arange(3000, dtype=np.uint32) % 70, [("1", 3000)], 50257))
    docs_, ids = range_coder.read_stream(bytes(raw))
    assert docs_ == [("1", 3000)] and np.array_equal(ids, np.arange(3000) % 70)
    raw[-20] ^= 1
    with pytest.raises(ValueError):
        range_coder.read_stream(bytes(raw))


def test_lm_base_and_counts(docs):
    rows = cases()
    words = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t, *_ in rows]
    out = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, *_ in rows]
    c = collections.Counter(w for ws, o in zip(words, out) if not o for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((d, o, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for (d, *_), ws, o in zip(rows, words, out)), key=key)
    got = pitman_yor.score_texts(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=key) == want
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_log_gamma():
    x = np.array([1e-3, 0.1, 0.5, 1, 2.5, 7, 100, 1e6])
    assert np.allclose(pitman_yor.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-9)


@pytest.mark.parametrize("c, theta, p, d", [(5, 2.0, 0.1, 0.4), (40, 30.0, 0.02, 0.7), (90, 5.0, 0.3, 0.5)])
def test_seatings_follow_the_exact_law(c, theta, p, d):
    law = {1: 1.0}  # weights of t tables after each customer
    for j in range(1, c):
        new: dict = {}
        for t, x in law.items():
            new[t] = new.get(t, 0) + x * (j - d * t) / c
            new[t + 1] = new.get(t + 1, 0) + x * (theta + d * t) * p / c
        law = new
    total, n, rng = sum(law.values()), 20_000, np.random.default_rng(1)
    row = lambda x: np.full(n, x)
    now = pitman_yor.walk(row(c), row(theta), row(p), d, rng)
    for _ in range(40):
        now = pitman_yor.gibbs(now, row(theta), row(p), d, rng)
    share = np.bincount(now.tables(), minlength=c + 1) / n
    assert max(abs(share[t] - x / total) for t, x in law.items()) < 0.015


def plain_model(docs, theta, sweeps, burn_in, rng):
    """Customers one by one, with every table's dish and size: averaged P(word | word before) of training pairs."""
    pairs = [(u, w) for ws in docs for u, w in zip(["."] + ws[:-1], ws)]
    counts = collections.Counter(pairs)
    share = lambda xs: min(0.9, max(0.1, xs.count(1) / max(xs.count(1) + 2 * xs.count(2), 1)))
    d, v, d0 = share(list(counts.values())), len({w for _, w in pairs}), 0.5
    low = collections.defaultdict(list)  # (context, word) -> sizes of tables
    top = collections.defaultdict(list)
    out = collections.Counter()

    def p_root(w):
        customers, tables = sum(map(sum, top.values())), sum(map(len, top.values()))
        return (sum(top[w]) - d0 * len(top[w]) + (theta + d0 * tables) / (v + 1)) / (theta + customers)

    def sit(sizes, disc, new):
        k = rng.choices(range(len(sizes) + 1), [*(x - disc for x in sizes), new])[0]
        if k == len(sizes):
            sizes.append(0)
        sizes[k] += 1
        return k == len(sizes) - 1 and sizes[k] == 1

    def leave(sizes):
        k = rng.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
            return True
        return False

    for sweep in range(sweeps):
        for u, w in pairs:
            if sweep and leave(low[u, w]):
                leave(top[w])
            tables = sum(len(x) for (c, _), x in low.items() if c == u)
            if sit(low[u, w], d, (theta + d * tables) * p_root(w)):
                sit(top[w], d0, (theta + d0 * sum(map(len, top.values()))) / (v + 1))
        d0 = share([sum(x) for x in top.values()])
        if sweep >= burn_in:
            for u, w in counts:
                c, t = (sum(f(x) for (y, _), x in low.items() if y == u) for f in (sum, len))
                out[u, w] += (sum(low[u, w]) - d * len(low[u, w]) + (theta + d * t) * p_root(w)) / (theta + c) / (sweeps - burn_in)
    return out


def test_scores_against_a_plain_sampler(spark):
    rng = random.Random(9)
    texts = {}
    for k in range(400):
        w = [rng.choice("abcd")]
        while len(w) < 6:
            w.append(rng.choice({"a": "bbbc", "b": "aad", "c": "cca", "d": "abcd"}[w[-1]]))
        if zlib.crc32(str(k).encode()) % 10 and len(texts) < 12:
            texts[k] = w
    model = plain_model([[*w, "."] for w in texts.values()], 1.0, 400, 100, rng)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    for chars, hot in ((1 << 20, 1 << 20), (30, 5)):
        got = {r.doc_id: r.score for r in pitman_yor.score_texts(df, chars=chars, hot=hot, sweeps=9, burn_in=3).collect()}
        want = {k: sum(math.log10(model[u, x]) for u, x in zip([".", *w], [*w, "."])) for k, w in texts.items()}
        assert abs(sum(got.values()) - sum(want.values())) < 0.03 * abs(sum(want.values()))
        assert all(abs(got[k] - want[k]) < 0.12 * abs(want[k]) for k in texts)


def test_long_words_are_told_apart():
    words = ["".join("ab"[(k.bit_count() + flip) % 2] for k in range(2048)) for flip in (0, 1)]
    h, n = pitman_yor.WordHasher().words([" ".join(words), "A a"])
    assert n.tolist() == [3, 3] and len(set(h.tolist())) == 4 and h[3] == h[4]


def test_language(spark):
    rng = random.Random(1)
    parts = {"aa": "ba be bi bo bu".split(), "bb": "sch ung lich keit ein".split()}
    rows = [(k, " ".join("".join(rng.choices(parts[l], k=3)) for _ in range(40)), l) for k in range(120) for l in (["aa", "bb"][k % 2],)]
    rows += [(500, None, "aa"), (501, "123 456", None), (502, "", "bb"), (None, "babebi", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify_language(df).collect()}
    assert all(got[d].lang_pred == l and got[d].accepted for d, t, l in rows[:120])
    assert all((got[d].lang_pred, got[d].score, got[d].accepted) == ("und", 0.0, False) for d in (500, 501, 502))
    assert language.keep_accepted(df).count() == sum(r.accepted for r in got.values())
    assert {r.lang_pred for r in language.identify_language(df.withColumn("lang", df.lang.substr(9, 9)).where("lang is null")).collect()} == {"und"}


def test_language_accepts_clean_texts_of_a_rare_language(spark):
    rng = random.Random(3)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwxyz"}
    words = {l: ["".join(rng.choices(x, k=rng.randint(3, 8))) for _ in range(400)] for l, x in letters.items()}
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    rare = [d for d in range(1000, 1100) if held(d)][:10] + [d for d in range(1000, 1100) if not held(d)][:3]
    rows = [(d, " ".join(rng.choices(words[l], k=300)), l) for d, l in [*((k, ["aa", "bb"][k % 2]) for k in range(300)), *((d, "cc") for d in rare)]]
    rows += [(2000, " ".join("".join(rng.choices("qrstuvwxyz" + "\u03b1\u03b2\u03b3\u03b4" * 9, k=6)) for _ in range(300)), None)]
    got = {r.doc_id: r for r in language.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[d].lang_pred == "cc" and got[d].accepted for d in rare)
    assert all(got[d].lang_pred == l and got[d].accepted for d, _, l in rows[:300])
    assert not got[2000].accepted


def test_kneser_ney_sums_to_one():
    keys = np.unique(language.grams(["abracadabra", "abba cab"])[0], return_counts=True)
    m = language.kneser_ney(["x"], [keys])
    letters = np.unique(keys[0] & np.uint64(0xFFFF))
    for context in ((32, 97, 98), (1, 2, 3)):
        high = sum(int(c) << 16 * (3 - k) for k, c in enumerate(context))
        total = m.prob(np.array([high | int(c) for c in letters], np.uint64)).sum() + m.prob(np.array([high | 9999], np.uint64)).sum()
        assert abs(total - 1) < 1e-9


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a>Home</a></nav>
<article class="post"><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;text<br>goes   on<p>Second<script>x("</p>")</script> one
<div class="newsletter">Sign up</div><aside>Side</aside><ul><li>a<li>b</ul></article><div id="comments"><p>Great!</p></div>
<form>Your name</form><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    rows = [(1, "http://a.b/c", PAGE, 1), (2, None, None, 2), (3, "::", "plain  text", 3), (None, "http://a.b/d", "", 4), (1, "http://a.b/c", PAGE, 1)]
    body = "<body><p>{}</p><p>all rights are reserved by the owners of this fine site</p></body>"
    rows += [(10 + k, "http://h.i/x", body.format(f"own text number {k} " + " ".join(f"w{k}x{j}" for j in range(30))), 0) for k in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    for part in (512, 1):
        got = collections.defaultdict(list)
        for r in html_text.extract_text(df, pages_per_part=part).collect():
            got[r.page_id].append(r.text)
            assert r.n_chars == len(r.text)
        assert got[1] == ["Title & more\nFirst bold text goes on\nSecond one\na\nb"] * 2
        assert got[2] == [""] and got[None] == [""] and got[3] == ["plain text"]
        assert all("reserved" not in got[10 + k][0] and f"w{k}x29" in got[10 + k][0] for k in range(4))


def test_html_keeps_all_parts_of_an_article():
    def kept(page):
        return [t for z, t in html_text.blocks_of(page) if z != html_text.OUTSIDE]

    parts = "<article><p>the longest part of all</p></article><article><p>part two</p></article>"
    assert kept(f"<body><nav>menu</nav><h4>Site</h4><main><header><h1>Title</h1></header>{parts}<article class='teaser'>next</article><h2>More</h2></main><article>elsewhere</article></body>") == ["Title", "the longest part of all", "part two"]
    assert kept(f"<body>{parts}<section class='related'><article>other</article></section></body>") == ["the longest part of all", "part two"]
    assert kept("<body><div>menu</div><div class='post'>one</div><div class='entry'>two and more</div><div class='comments'><div class='post'>hi</div></div></body>") == ["one", "two and more"]
    assert kept("<div id='content'><h1>Title</h1><article>text</article><h2>Later</h2></div>") == ["Title", "text"]


def test_html_tells_boilerplate_from_passages(spark):
    own = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(9)]
    menu = " ".join(f"menu{j}" for j in range(60))
    passage = " ".join(f"quoted{j}" for j in range(50))
    rows = [(k, "http://o.p/x", f"<body><div>{menu}</div><div>{own[k]}</div>{f'<div>{passage}</div>' if k < 2 else ''}</body>") for k in range(8)]
    copy = f"<body><div>{own[8]}</div></body>"
    rows += [(20 + k, "http://q.r/x", copy) for k in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for part in (512, 2):
        got = {r.page_id: r.text for r in html_text.extract_text(df, pages_per_part=part).collect()}
        assert [got[k] for k in range(8)] == [own[k] + (f"\n{passage}" if k < 2 else "") for k in range(8)]
        assert all(got[20 + k] == own[8] for k in range(6))


def test_html_removes_shared_edges_of_articles(spark):
    ask = " ".join(f"ask{j}" for j in range(50))
    page = "<article><p>Contents</p><p>{}</p><p>said on every page, in the middle, and so it stays</p><p>{}</p><p>" + ask + "</p><p>Share</p></article>"
    text = lambda k, c: " ".join(f"{c}{k}x{j}" for j in range(12))
    rows = [(k, "http://o.p/x", page.format(text(k, "a"), text(k, "b"))) for k in range(8)]
    rows += [(20 + k, "http://q.r/x", page.format("same", "same")) for k in range(6)]
    rows += [(30 + k, "http://s.t/x", page.format(text(k, "a"), text(k, "b"))) for k in range(4)]  # too few pages to tell
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for part in (512, 2):
        got = {r.page_id: r for r in html_text.extract_text(df, pages_per_part=part).collect()}
        middle = "said on every page, in the middle, and so it stays"
        assert all(got[k].text == f"Contents\n{text(k, 'a')}\n{middle}\n{text(k, 'b')}" and got[k].removed_words == 51 for k in range(8))
        assert all(got[k].text.endswith("Share") and got[k].removed_words == 0 for k in (*range(20, 26), *range(30, 34)))


def streams(rng, pages, words, blocks, size):
    return [[(rng.choice([html_text.INSIDE, html_text.OPEN, html_text.OUTSIDE]), " ".join(rng.choices(words, k=rng.randint(1, size)))) for _ in range(rng.randint(1, blocks))] for _ in range(pages)]


def test_suffix_array_against_plain_search():
    rng = random.Random(6)
    for _ in range(25):
        pages = streams(rng, rng.randint(1, 6), ["a", "b", "c"][: rng.randint(1, 3)], 4, rng.choice([5, 40]))
        s = html_text.HostStream(pages)
        flat = [t.split() for p in pages for _, t in p]
        suffixes = [w[k:] for w in flat for k in range(len(w))]
        names = [tuple(x) for x in suffixes]
        number = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for x in flat for w in x))}
        keys = [tuple(number[w] for w in x) for x in names]
        assert [keys[k] for k in s.order] == sorted(keys)
        for i in range(1, len(names)):
            x, y = names[s.order[i - 1]], names[s.order[i]]
            n = next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
            assert s.lcp[i] == n + (len(x) == len(y) == n)


def test_repeated_runs_against_plain_search():
    rng = random.Random(7)
    for _ in range(25):
        pages = streams(rng, 5, ["a", "b"], 3, 25)
        for least in (2, 3):
            s = html_text.HostStream(pages)
            group, _, _ = s._groups()
            seen = collections.defaultdict(set)
            for p, blocks in enumerate(pages):
                for _, t in blocks:
                    w = t.split()
                    for k in range(max(1, len(w) - 7)):
                        seen[len(w) < 8, tuple(w[k : k + 8])].add(p)
            want = []
            for blocks in pages:
                for _, t in blocks:
                    w = t.split()
                    hit = [False] * len(w)
                    for k in range(max(1, len(w) - 7)):
                        if len(seen[len(w) < 8, tuple(w[k : k + 8])]) >= least:
                            hit[k : k + 8] = [True] * len(w[k : k + 8])
                    want += hit
            of = collections.defaultdict(set)
            for k in np.flatnonzero(s.whole):
                of[group[k]].add(s.page[k])
            assert s.covered(np.array([len(of[g]) >= least for g in group])).tolist() == want


def test_html_quotes_and_compound_names():
    def kept(page):
        return [t for z, t in html_text.blocks_of(page) if z != html_text.OUTSIDE]

    assert kept("<p>one <a href=/don't>link</a> two</p><p>three</p>") == ["one link two", "three"]
    assert kept('<p class="x>Hello there</p>') == ["Hello there"]
    assert kept("<p title='a > b' data-x=\"it's\">text</p>") == ["text"]
    parts = "<div class='share-price'>Price</div><section id='related-work'>Work</section><div class='share-buttons'>Share</div><div id='site-footer'>Foot</div><div class='cookie-notice-bar'>Cookies</div><p>End</p>"
    assert kept(f"<article>{parts}</article>") == ["Price", "Work", "End"]


def test_array_removes_most_of_what_structure_would(spark):
    """On the given pages, with the choice of the article left out, what is not a repeated run is nearly the article."""
    import pathlib

    folder = pathlib.Path("/root/testdata/sf0.1/pages.parquet")
    if not folder.exists():
        pytest.skip("the given tables are absent")
    rows = html_text.extract_text(spark.read.parquet(str(folder))).collect()
    removed, rest, kept = (sum(x) for x in zip(*((r.removed_words, r.structure_words, r.text.count(" ") + r.text.count("\n") + 1) for r in rows)))
    assert removed > 0.6 * (removed + rest) and rest < 0.03 * kept and max(r.longest_run for r in rows) >= html_text.HostStream.DEPTH


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (exact_dedup.exact_dedup(empty), quality_rules.apply_policy(quality_rules.rule_ledger(empty)), simhash.simhash_groups(empty), bpe.bpe_encode(empty), packing.pack(empty), token_counts.token_counts(empty), range_coder.round_trip(empty), language.identify_language(empty), pitman_yor.score_texts(empty), html_text.extract_text(pages)):
        assert out.collect() == []


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(cases(), SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            docs = out.cache()
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()

"""Every operator against brute force or exact round trips, on edge cases:
null and empty texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowlens.llm import catalog, chat, fingerprints, line_dedup, mixing, neighbours, ngram_join, packing, substring_dedup, tokens, toxicity
from flowlens.llm.common import in_order, with_totals_before
from flowlens.llm.components import components
from flowlens.llm.fm_index import FMIndex, range_minimum
from flowlens.llm.tokens import Encoder
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the a of red blue idiot moon été straße x1 y2 zz kind word other seven eight nine".split()
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _corpus(n=60, seed=1):
    rng = random.Random(seed)
    passage = " ".join(rng.choice(WORDS) for _ in range(40))
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" if rng.random() < 0.8 else rng.choice(WORDS) for _ in range(rng.choice([3, 5, 30, 120, 600]))]
        text = "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))
        if i % 5 == 0:
            text += "\n" + passage
        if i % 7 == 3 and rows:
            text = rows[-1][1]
        if i % 7 == 4 and rows and rows[-1][1]:
            text = rows[-1][1].replace(" the ", " a ", 1) + " tail"
        rows.append((i, text, "en", f"s{i % 4}" if i % 11 else None, 0))
    rows += [(1000, None, "en", "s1", 0), (1001, "", "en", "s1", 0), (1002, " \n\t ", "en", "s0", 0), (1003, "one", "en", None, 0), (1004, "ONE", "en", None, 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_corpus(), SCHEMA)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _odd(spark):
    """Tables no operator may stumble over: empty; null ids and repeated rows; clashing columns."""
    empty = spark.createDataFrame([], SCHEMA)
    nulls = spark.createDataFrame([(None, "a b c", "x", None, None), (None, None, None, None, None), (1, "a b c", "x", "s", 1), (1, "a b c", "x", "s", 1), (1, "other text here", "x", "s", 1)], SCHEMA)
    clash = nulls.where("doc_id is not null")
    for c in ("size", "key", "copies", "taken", "level", "uid", "bucket", "start", "length", "sequence_id", "text_hash", "component", "kind", "starts"):
        clash = clash.withColumn(c, F.lit("mine"))
    return empty, nulls, clash


def test_every_operator_takes_odd_tables(spark):
    for table in _odd(spark):
        n = table.count()
        assert mixing.mixing_table(table).count() == n
        assert mixing.mix(table).columns == table.columns
        assert packing.packed_documents(table, TOKENIZER).count() == n
        assert ngram_join.similar_groups(table).count() == n
        assert fingerprints.fingerprint_table(table).count() == n
        assert substring_dedup.dedup_substrings(table).count() == n
        assert tokens.token_table(table, TOKENIZER).count() == n
        assert line_dedup.dedup_lines(table).count() == n
        model = toxicity.train_toxicity(table, table.select("doc_id", F.lit(0).alias("toxic")))
        scored = toxicity.score_toxicity(table, model)
        assert [c for c in scored.columns if c != "toxicity_score"] == table.columns and scored.count() == n


def test_mixing_meets_targets(docs):
    rows = [r.asDict() for r in mixing.mixing_table(docs).collect()]
    again = [r.asDict() for r in mixing.mixing_table(docs).collect()]
    order = lambda rs: sorted(map(repr, rs))
    assert order(rows) == order(again)
    texts = {r[0]: r[1] for r in _corpus()}
    assert all(r["size"] == len(_words(texts[r["doc_id"]])) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    names = sorted([s for s in by if s is not None]) + [None]
    total = sum(r["size"] for r in rows)
    own = {s: sum(r["size"] for r in by[s]) for s in names}
    weight = dict(zip(names, itertools.cycle([5, 2, 1])))
    target, free, left = {}, set(names), float(total)
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * own[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * own[s]
            left -= target[s]
        free -= full
    target |= {s: level * weight[s] for s in free}
    for s in names:
        assert by[s][0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in by[s]) - target[s]) <= max(600, 0.05 * target[s])


def test_mix_repeats_rows(docs):
    taken = Counter({(r.doc_id): r.copies for r in mixing.mixing_table(docs).collect() if r.copies})
    assert Counter(r.doc_id for r in mixing.mix(docs).collect()) == taken


def test_plan_packs_everything_once():
    rng = random.Random(2)
    for capacity in (7, 64, 2048):
        counts = Counter(rng.choice([rng.randint(1, capacity), capacity, max(1, capacity // 3)]) for _ in range(3000))
        runs, n = packing.plan_packing(counts, capacity)
        load, placed = Counter(), Counter()
        for length, a, b, first, at in runs:
            placed[length] += b - a
            for s in range(first, first + b - a):
                assert load[s] >= 0
                load[s] += length
        assert placed == counts and max(load.values()) <= capacity and len(load) == n
        assert n <= -(-sum(k * v for k, v in counts.items()) // capacity) * 1.05 + 2


def test_packing_is_gapless(docs):
    rows = packing.packed_documents(docs, TOKENIZER).collect()
    t = Tokenizer.from_file(TOKENIZER)
    ids = {d: t.encode(x or "", add_special_tokens=False).ids + [0] for d, x, *_ in _corpus()}
    for d, want in ids.items():
        mine = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in mine) == np.array(want, "<u4").tobytes()
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]] and all(r.length == 2048 for r in mine[1:])
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_encoder_is_the_tokenizer():
    rng, t, e = random.Random(3), Tokenizer.from_file(TOKENIZER), Encoder(TOKENIZER)
    parts = ["a", "é", "ß", " ", "  ", "\n", " \n", "\n\n", "\t", ".", "'s", "1", "漢", "ﬁ", "\x85", "´", "²", "😀", "<|endoftext|>", ",", "\r\n", "B", " x"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert e.encode([text])[0] == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_planes_round_trip():
    rng = np.random.default_rng(4)
    for n in (1, 7, 65536):
        ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        assert (tokens.from_planes(*tokens.to_planes(ids), n) == ids).all()


def test_token_files_round_trip(docs):
    t, start = Tokenizer.from_file(TOKENIZER), 0
    rows = {r.doc_id: r for r in tokens.token_table(docs, TOKENIZER).collect()}
    for d, text, *_ in sorted(_corpus()):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert rows[d].start == start and bytes(rows[d].ids) == np.array(ids, "<u4").tobytes()
        start += len(ids)


def _brute_groups(rows, n=5):
    sets = {}
    for d, text, *_ in rows:
        w = _words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[d] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    group = {d: d for d in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            group[y] = x
    return {(d, len(sets[d]), find(d)) for d in sets}


def test_ngram_join_is_exact(spark, docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs).collect()}
    assert got == _brute_groups(_corpus())


def test_ngram_join_large_groups_of_near_copies(spark):
    """Chains of near copies in one group: far ends are linked only through others."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for i in range(70):
        w = list(base)
        for k in rng.sample(range(80), rng.choice([0, 1, 2, 3, 5])):
            w[k] = f"n{i}_{k}"
        rows.append((i, " ".join(w), "", "", 0))
        if i % 10 == 9:
            base[rng.randrange(80)] = f"drift{i}"
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == _brute_groups(rows)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    group = {}
    for a, b in edges:
        group.setdefault(a, a), group.setdefault(b, b)
    for _ in range(len(group)):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: g for n, g in group.items() if n in got} and {n for n, g in group.items() if list(group.values()).count(g) > 1} == set(got)


def _canon(text):
    nfkc = lambda t: unicodedata.normalize("NFKC", t)
    return " ".join(nfkc(nfkc(text or "").casefold()).split())


def test_fingerprints(spark):
    rows = _corpus() + [(2000, "Café  ﬁne", "", "", 0), (2001, "CAFÉ fine ", "", "", 0), (2002, "cafe fine", "", "", 0)]
    table = spark.createDataFrame(rows, SCHEMA)
    order = fingerprints.followers(table)
    out = fingerprints.with_copies(fingerprints.fingerprint_table(table, order), fingerprints.duplicate_groups(table, order)).collect()
    got = {r.doc_id: r for r in out}
    rows, canon = sorted(rows), {d: _canon(t) for d, t, *_ in rows}
    sizes = Counter(canon.values())
    for (d, text, *_), (_, after, *_) in zip(rows, rows[1:] + rows[:1]):
        text, n = text or "", len(text or "")
        edited = text[: n - n // 4] + (after or "")[: n // 4]
        assert got[d].edited == edited and got[d].n_chars == n and got[d].copies == sizes[canon[d]]
        assert got[d].near_edited == float(_canon(edited) == canon[d])
    assert got[2000].fingerprint == got[2001].fingerprint != got[2002].fingerprint
    assert len({r.fingerprint for r in out}) == len(set(canon.values()))


def test_toxicity_tells_rare_stems(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        words = ["".join(rng.choice(["an", "er", "the", "on", "re"]) for _ in range(rng.randint(1, 3))) for _ in range(60)]
        if i % 4 == 0:
            words[rng.randrange(60)] = "vequ" + rng.choice(["an", "er", "on"]) + rng.choice("abcdefg")
        rows.append((i, " ".join(words), i % 4 == 0))
    table = spark.createDataFrame([(i, t, int(y)) for i, t, y in rows], "doc_id long, text string, toxic int")
    model = toxicity.train_toxicity(table, table.where("doc_id < 300"))
    got = {r.doc_id: r.toxicity_score for r in toxicity.score_toxicity(table, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i >= 300]
    assert all(0 <= s <= 1 for s, _ in held)
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95


def test_toxicity_ratios_are_kneser_ney(spark):
    """The ratio of every expression against the formula over plain dictionaries."""
    rng = random.Random(14)
    rows = [(k, " ".join(rng.choice(WORDS) + rng.choice(["", "ish", "o"]) for _ in range(12)), k % 3 == 0) for k in range(90)]
    table = spark.createDataFrame([(d, t, int(y)) for d, t, y in rows], "doc_id long, text string, toxic int")
    model = toxicity.train_toxicity(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    u = F.xxhash64(F.lit(5), "doc_id", "toxic").bitwiseAND(F.lit(2**40 - 1)) / float(2**40)
    counted = [(r.text, r.toxic) for r in table.where(u < toxicity.COUNTED).collect()]
    cut = lambda text: re.findall(rb"[a-z\x80-\xff]+", text.encode().lower())
    seen, follow = (Counter(), Counter()), {}
    for text, y in counted:
        for w in cut(text):
            for k in range(len(w)):
                seen[y][w[: k + 1]] += 1
                follow.setdefault(w[:k], set()).add(w[k])
    keys = {*seen[0], *seen[1]}
    tail = lambda p: (b"\0\0" + p)[-2:]
    n = Counter((tail(k[:-1]), k[-1]) for k in keys)
    single = Counter(letter for _, letter in n)
    total, kinds = Counter(), Counter(t for t, _ in n)
    for (t, _), c in n.items():
        total[t] += c
    d = toxicity.DISCOUNT

    def p(y, prefix, letter):
        back = (single[letter] + 0.5) / (sum(single.values()) + 128)
        t = tail(prefix)
        if total[t]:
            back = (max(n[t, letter] - d, 0) + d * kinds[t] * back) / total[t]
        after = [seen[y][prefix + bytes([x])] for x in follow.get(prefix, ())]
        if not sum(after):
            return back
        return (max(seen[y][prefix + bytes([letter])] - d, 0) + d * sum(a > 0 for a in after) * back) / sum(after)

    text = " ".join(r[1] for r in rows) + " moonish unseen zzzz été"
    for _, words in toxicity._letters(toxicity.pa.array([text])):
        ratios = model.counts.ratios(words)
        own = cut(text)
        assert len(ratios) == len(own)
        for w, r in zip(own, ratios.tolist(), strict=True):
            want = sum(np.log(p(1, w[:k], w[k]) + 1e-15) - np.log(p(0, w[:k], w[k]) + 1e-15) for k in range(len(w)))
            assert r == pytest.approx(want, abs=1e-6)


def test_toxicity_reads_whole_runs(spark):
    rng, rows = random.Random(9), []
    for i in range(300):
        run = "".join(chr(rng.randrange(0x4E00, 0x4E60)) for _ in range(60))
        at = rng.randrange(12, 56)
        rows.append((i, run[:at] + "\u8fb1\u9a82\u8bcd" + run[at:] if i % 3 == 0 else run, int(i % 3 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train_toxicity(table, table.where("doc_id < 200"))
    got = {r.doc_id: r.toxicity_score for r in toxicity.score_toxicity(table, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 200]) > 0.95


def test_toxicity_keeps_contexts_seen_once(spark):
    table = spark.createDataFrame([(k, f"plain words {'vile' * (k % 2)} once{chr(97 + k % 10)}{chr(97 + k // 10)}", k % 2) for k in range(60)], "doc_id long, text string, toxic int")
    counts = toxicity.train_toxicity(table, table).counts
    assert counts.seen.sum(0).min() == 1 and (np.diff(counts.keys.astype(object)) > 0).all()


def test_substring_dedup_is_exact(docs):
    rows = sorted(_corpus())
    first, got = {}, {r.doc_id: r for r in substring_dedup.dedup_substrings(docs).collect()}
    for d, text, *_ in rows:
        w = _words(text)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), d)
    for d, text, *_ in rows:
        w = _words(text)
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < d for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[d].words, got[d].removed, got[d].kept) == (len(w), len(gone), kept)


def test_fm_index_counts():
    rng = np.random.default_rng(8)
    text = rng.integers(0, 4, 500)
    text[-1] = 0
    index = FMIndex(text, 5)
    start = np.array([k for k in range(495) if (text[k : k + 5] > 0).all()])
    low, high = index.ranges(text, start, 5)
    for s, a, b in zip(start, low, high):
        places = {k for k in range(496) if (text[k : k + 5] == text[s : s + 5]).all()}
        assert set(index.order[a:b].tolist()) == places
    v = rng.integers(0, 100, 50)
    a = rng.integers(0, 40, 30)
    b = a + rng.integers(1, 10, 30)
    assert range_minimum(v, a, b).tolist() == [v[x:y].min() for x, y in zip(a, b)]


def test_neighbours_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((1500, 16))
    v[300:700] = v[300]
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    bad = [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] * 16)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, lambda i: i % 100 == 0).toPandas()
    hit = total = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 10 and (mine["rank"].to_numpy() == np.arange(1, 11)).all()
        assert np.allclose(mine.score, d[mine.vec_id], rtol=0, atol=1e-12)
        hit, total = hit + len(set(mine.vec_id) & set(want)), total + 10
        if 300 <= q < 700:
            assert mine.vec_id.tolist() == want.tolist()
    assert hit / total >= 0.9 and got.query_id.max() < 5000
    assert neighbours.nearest(table.limit(0), lambda i: i % 100 == 0).count() == 0
    few = neighbours.nearest(table.where("vec_id < 4"), lambda i: i % 100 == 0).collect()
    assert len(few) == 3


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|x"), (1, 2, "bob", "ho"), (1, 3, None, None), (2, 0, "system", "x"), (None, 1, "ann", "lone"), (3, 300, "ann", "late"), (3, 2, "bob", "early")]
    out = {(r.conv_id, r.speaker, r.part): r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {(1, "ann", 0), (1, "bob", 0), (1, "unknown", 0), (None, "ann", 0), (3, "ann", 0), (3, "ann", 1), (3, "bob", 0), (3, "bob", 1)}
    r = out[1, "ann", 0]
    assert r.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |x<|im_end|>\n<|im_start|>user name=bob\nho<|im_end|>\n<|im_start|>user name=unknown\n<|im_end|>\n"
    assert [r.text[s.start : s.stop] for s in r.spans] == ["hi < |x<|im_end|>"]
    assert out[3, "ann", 0].spans == [] and chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_keeps_speakers_apart(spark):
    want = {"Анна": "Анна", "Борис": "Борис", "李": "李", "a b": "a%20b", "a_b": "a_b", "a  b": "a%20%20b", "a%20b": "a%2520b", "x<|y": "x%3C|y", "é\u00a0!": "é%C2%A0!", "unknown": "%75nknown", " ": "unknown", "n\nm": "n%0Am"}
    rows = [(1, k, role, f"t{k}") for k, role in enumerate([*want, " a_b "])]
    out = {r.speaker: r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == set(want.values())
    for k, (role, name) in enumerate(want.items()):
        r = out[name]
        said = [f"t{k}<|im_end|>"] + (["t12<|im_end|>"] if role == "a_b" else [])
        assert [r.text[s.start : s.stop] for s in r.spans] == said
        assert {x.partition("name=")[2] for x in r.text.split("\n") if "name=" in x} == set(want.values()) - {name}


def test_line_dedup_by_windows(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny"), (3, "a\na\na\na\na"), (4, None), (5, ""), (6, "a\nb\nc")]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[d].text for d in range(1, 7)] == ["a\nb\nc\nd", "x\ny", "a", None, "", ""]
    assert [out[d].lines_removed for d in range(1, 7)] == [0, 3, 4, 0, 0, 3]


def test_totals_in_order(spark):
    rng = random.Random(10)
    rows = [(rng.randrange(50), k, rng.randrange(9)) for k in range(500)]
    df = spark.createDataFrame(rows, "a long, b long, v long")
    got = {(r.a, r.b): r.before for r in with_totals_before(in_order(df, ["a", "b"], "t"), ["a", "b"], F.col("v"), "before").collect()}
    total = 0
    for a, b, v in sorted(rows):
        assert got[a, b] == total
        total += v


def test_catalog_names():
    assert {n.split("_")[0] for n in catalog.QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and zlib and hashlib


def test_encoder_of_other_files_is_the_tokenizer():
    """A file whose words lose their case and blanks: its texts are encoded whole."""
    path = public_tokenizers.path("word_bpe_49k.json")
    e, t = Encoder(path), Tokenizer.from_file(path)
    assert not e.in_pieces and Encoder(TOKENIZER).in_pieces
    texts = ["Some Words here", "x  y\n z", "", "ÄÖ ß!"]
    assert e.encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]

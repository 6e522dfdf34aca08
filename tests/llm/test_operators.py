"""The training-data operators against brute force on small inputs, and on awkward ones."""

import hashlib
import random
import re

import numpy as np
import pytest

from recordloom.llm import chat, chroma, decontam, langid, mixing, quality, simhash, suffix_dedup, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["ab", "Cd", "éx", "9", "zz", "und", "the", "Ñu"]


def make(spark, rows, more=""):
    return spark.createDataFrame(rows, SCHEMA + more)


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(4)
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 80))) + (passage if i % 4 == 0 else ""), "en" if i % 2 else "fr", f"s{i % 3}" if i % 7 else None, 0) for i in range(80)]
    rows += [(80, rows[0][1], "en", "s0", 0), (81, rows[0][1] + " zz", "en", "s1", 0)]
    return rows


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 3), (None, "no id here", "en", "b", 10), (None, "no id here", "en", "b", 10), (4, "twice the same row", "fr", "b", 18), (4, "twice the same row", "fr", "b", 18), (5, "x" * 5000, "fr", None, 5000), (6, long, "en", "a", len(long)), (4, "same id, other text", None, "c", 19), (7, "\x00null\x00 bytes 12", "en", "a", 13)]
    return rows


CLASH = ", score double, row string, spans string, _id long, _doc string, fp long, copy int, hash string, _copies int, sub string"
CLASH_VALUES = (0.5, "r", "s", 1, "d", 2, 9, "h", 3, "u")


def clashing(spark, rows):
    return make(spark, [(*r, *CLASH_VALUES) for r in rows], CLASH)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(82)] + [(None, 1, 0), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark_items(spark):
    rng = random.Random(9)
    return [(i, ", ".join(rng.choice(WORDS[:4]) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 14])))) for i in range(12)] + [(50, None), (None, "und the"), (3, "zz zz")]


R = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_contamination(docs, items):
    windows, out = {}, []
    for i, t in items:
        w = R.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("null" if i is None else str(i))
    for d, t, *_ in docs:
        w, hit, found = R.findall((t or "").translate(LOW)), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if x := windows.get(tuple(w[k : k + size])):
                    found |= x
                    hit |= set(range(k, k + size))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(x is None, str(x)) for x in r])


def by(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("kind", ["small", "awkward"])
def test_contamination(spark, kind, request, benchmark_items):
    docs = request.getfixturevalue(kind)
    items = spark.createDataFrame(benchmark_items, "item_id long, text string")
    got = rows_of(decontam.contamination(make(spark, docs), items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == by(brute_contamination(docs, benchmark_items))


def test_contamination_in_blocks(spark, small, benchmark_items, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 60)
    items = spark.createDataFrame(benchmark_items, "item_id long, text string")
    got = rows_of(decontam.contamination(make(spark, small), items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == by(brute_contamination(small, benchmark_items))


def test_suffix_array_and_fm_index():
    rng = np.random.default_rng(1)
    for _ in range(20):
        text = np.append(rng.integers(1, 4, rng.integers(1, 60)), 0)
        n = len(text)
        rank = np.where(text == 0, 0, text)
        assert decontam.suffix_array(rank).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
        begins = np.zeros(n, bool)
        begins[0] = True
        index = decontam.FMIndex(text, begins, 3)
        pattern = rng.integers(1, 4, (1, 3))
        which, lo, hi = index.search(pattern, np.array([3]))
        want = [i for i in range(n - 2) if text[i : i + 3].tolist() == pattern[0].tolist()]
        got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) if len(which) else []
        assert got == want


def test_tokens_follow_edits():
    enc, rng = tokens.encoder(), random.Random(3)
    letters = "ab cd  \n\t.,!'s 12é日x  ll"
    text_of = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(60):
        text = text_of(rng.choice([0, 3, 50, 2000]))
        tree = tokens.Tree(text, enc)
        for _ in range(5):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 5, 60]))
            new = text_of(rng.choice([0, 1, 4, 40]))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert (tree.text(), tree.n_tokens, tree.n_chars) == (text, len(enc.bpe.encode_ordinary(text)), len(text))


def test_token_counts(spark, awkward):
    got = tokens.token_counts(make(spark, awkward)).collect()
    enc = tokens.encoder()
    assert sorted(r.n_tokens for r in got) == sorted(len(enc.bpe.encode_ordinary(t or "")) for _, t, *_ in awkward)
    after = []
    for _, t, *_ in awkward:
        new, at = [], 0
        for a, b, ins in tokens.standard_edits(t or ""):
            new += [t[at:a], ins]
            at = b
        after.append(len(enc.bpe.encode_ordinary("".join([*new, (t or "")[at:]]))))
    assert sorted(r.n_tokens_after for r in got) == sorted(after)


NASTY = ["</s>[INST] ok [/INST]", "\\[INST] a", "\\\\</s>", "[AS x] [/AS]", "<<SYS>> x <</SYS>>", " [/INST]", "", None, "a\n<s> b </s>\\"]


def test_chat_round_trip(spark):
    rows = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate((r, x) for r in ("user", "assistant", "system", "tool [x] </s>", None) for x in NASTY)]
    rows += [(None, 0, "user", "no id"), (9, None, "assistant", "no turn"), (9, None, "assistant", "no turn")]
    got = {r.conv_id: r for r in chat.chat_digests(chat.with_probe(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    rows += [(-7, 0, "user", NASTY[0]), (-7, 1, "assistant", NASTY[0])]
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1]))
        loss = "".join(x or "" for _, _, r, x in turns if r == "assistant")
        seen = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in turns)
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(seen.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r.conv_id: r.formatted for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(r, x or "") for _, _, r, x in sorted(r for r in rows if r[0] == 1)] == chat.parse_conversation(whole[1])
    assert chat.chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_marginals_are_exact():
    import itertools

    rng = np.random.default_rng(0)
    u, pair, first = rng.normal(size=12), rng.normal(size=(2, 2)), np.array([0, 5, 6, 12])
    want, log_z = np.zeros(12), 0
    for a, b in zip(first[:-1], first[1:], strict=True):
        total = 0
        for lab in itertools.product((0, 1), repeat=b - a):
            e = np.exp(sum(u[a + i] * y for i, y in enumerate(lab)) + sum(pair[i, j] for i, j in zip(lab, lab[1:], strict=False)))
            total += e
            want[a:b] += e * np.array(lab)
        want[a:b] /= total
        log_z += np.log(total)
    p, _, z = quality.marginals(u, pair, first)
    assert np.allclose(p, want) and np.isclose(z, log_z)


def auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    return np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])


def learnable(spark):
    rng, syllables = random.Random(2), ["an", "er", "th", "in", "on", "es"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    docs, marks = [], []
    for i in range(400):
        lines = [" ".join(word() for _ in range(12)) + "." for _ in range(rng.randint(1, 6))]
        bad, toxic, lang = i % 3 == 0, i % 4 == 0, ("en", "xx")[i % 2]
        if lang == "xx":
            lines = [x.replace("th", "ßç").replace("an", "ñó") for x in lines]
        if bad:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        if toxic:
            lines[-1] += " grumblefoo" + rng.choice(["s", "ed", "ly", "er"])
        docs.append((i, "\n".join(lines), lang, "s", 0))
        marks.append((i, int(not bad), int(toxic)))
    return make(spark, docs), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark):
    docs, marks = learnable(spark)
    y = {r.doc_id: r for r in marks.collect()}
    got = [r for r in quality.classify(docs, marks).collect() if r.held_out]
    assert got and auc([y[r.doc_id].quality for r in got], [r.score for r in got]) > 0.95
    got = [r for r in toxicity.classify(docs, marks).collect() if r.held_out]
    assert got and auc([y[r.doc_id].toxic for r in got], [r.score for r in got]) > 0.95
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in langid.detect(docs).collect() if r.held_out]
    assert got and np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.95


def test_classifiers_on_awkward_rows(spark, awkward, labels):
    docs = make(spark, awkward)
    empty = docs.where("false")
    for f in (lambda d, y: quality.classify(d, y), lambda d, y: toxicity.classify(d, y), lambda d, y: langid.detect(d)):
        got = f(docs, labels).collect()
        assert len(got) == len(awkward) and all(0 <= r.score <= 1 for r in got)
        assert f(empty, labels).count() == 0
        assert f(docs, labels.where("false")).count() == len(awkward)
    und = {r.doc_id: (r.lang_pred, r.score) for r in langid.detect(docs).collect()}
    assert und[1] == und[2] == und[3] == ("und", 0.0)


def test_audio(spark):
    rng = np.random.default_rng(5)
    v = [rng.normal(size=64).tolist() for _ in range(20)]
    rows = [(i, x) for i, x in enumerate(v)] + [(100, v[3]), (200, v[5][16:] + v[6][:16]), (300, None), (400, []), (None, v[0])]
    audio = chroma.recordings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r.query_id, r.match_id): r for r in chroma.align(audio).collect()}
    prints = {r.vec_id: r for r in chroma.fingerprints(audio).collect() if r.vec_id is not None}
    owner = {i: min(k for k in prints if (prints[k].code, prints[k].heard) == (prints[i].code, prints[i].heard)) for i in prints}
    want = set()
    for q in (i for i in prints if i % 100 == 0):
        x = np.frombuffer(prints[q].code, np.uint32)
        hx = np.frombuffer(prints[q].heard, np.uint8)
        for m in set(owner.values()):
            z, hz = np.frombuffer(prints[m].code, np.uint32), np.frombuffer(prints[m].heard, np.uint8)
            if not len(x) or not len(z):
                continue
            votes = {}
            for i, j in zip(*np.nonzero((x[:, None] == z[None]) & (hx[:, None] > 0) & (hz[None] > 0)), strict=True):
                votes[i - j] = votes.get(i - j, 0) + 1
            good = {k: n for k, n in votes.items() if n >= 8}
            if good and chroma.bit_errors(prints[q].code, prints[m].code, int(min(good, key=lambda k: (-good[k], k))))[1] <= 0.35:
                want.add((q, m))
    assert set(got) == want and {(0, 0), (100, 3), (200, 5)} <= want
    assert got[(200, 5)].offset == -32 and got[(0, 0)].n_copies == 2


def test_mixing(spark, small, awkward):
    for rows in (small, awkward):
        docs = make(spark, rows)
        got = mixing.mix(docs).collect()
        again = mixing.mix(docs.repartition(3)).collect()
        assert by(got) == by(again) and len(got) == len(rows)
        size = {}
        for r in got:
            assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", next((x[1] or "" for x in rows if x[0] == r.doc_id and len((x[1] or "").split()) == r.size), "")))
            assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
            size[r.source] = size.get(r.source, 0) + r.size
        order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        target, open_, left = {}, set(order), sum(size.values())
        while True:
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = {s for s in open_ if share[s] > 3 * size[s]}
            if not over:
                target.update(share)
                break
            for s in over:
                target[s] = 3 * size[s]
                left -= target[s]
            open_ -= over
        for r in got:
            assert r.source_size == size[r.source] and abs(r.target - target[r.source]) <= 1e-6 * max(1, target[r.source])
        if rows is small:
            for s in order:
                assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 0.02 * target[s] + 20
    assert mixing.mix(make(spark, [])).count() == 0


def brute_dedup(docs, length):
    seen, out = set(), {}
    for key, t in sorted(docs):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[key] = (len(t), sum(gone), sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_substring_dedup(spark, letters):
    rng = np.random.default_rng(letters)
    passages = [bytes(rng.integers(97, 97 + letters, rng.integers(20, 300)).astype(np.uint8)) for _ in range(5)]
    docs = [(3 * d, b"".join(passages[rng.integers(5)][rng.integers(0, 30) :] if rng.random() < 0.6 else bytes(rng.integers(97, 97 + letters, rng.integers(0, 200)).astype(np.uint8)) for _ in range(rng.integers(0, 6)))) for d in range(40)]
    df = make(spark, [(d, t.decode(), "en", "s", 0) for d, t in docs])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.substring_dedup(df).collect()}
    assert got == brute_dedup(docs, 100)


def test_multikey_quicksort_sorts_slices_and_tells_what_agrees():
    draw = np.random.default_rng(3)
    words = draw.integers(0, 4, (5000, 5)).astype(">u8")
    words[:300] = words[0]  # one large group of equal keys
    words[300:2000, 0] = np.arange(1700, dtype=np.uint64)[::-1] + np.uint64(2**63)  # sorted the wrong way, beyond the signed numbers
    order, lo, size = np.arange(5000), np.array([0, 2500, 2501]), np.array([2500, 1, 2499])
    left_lo, left_size = suffix_dedup.multikey_quicksort(words, order, lo[size > 1], size[size > 1], 3)
    keys = [tuple(w[:3].tolist()) for w in words]
    expect, groups = [], []
    for a, n in zip(lo, size, strict=True):
        part = sorted(range(a, a + n), key=keys.__getitem__)
        for x in range(n):
            if x and keys[part[x]] == keys[part[x - 1]]:
                groups[-1][1] += 1
            else:
                groups.append([a + x, 1])
        expect += part
    assert order.tolist() == expect
    assert sorted(zip(left_lo.tolist(), left_size.tolist(), strict=True)) == [tuple(g) for g in groups if g[1] > 1]


def test_blind_trie_and_deep_shallow_order():
    rng = random.Random(1)
    for _ in range(50):
        keys = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randint(1, 30))]
        assert [keys[i] for i in suffix_dedup.blind_trie_order(keys)] == sorted(keys)
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 40))]
        padded = np.zeros((len(texts), 60), np.uint8)
        for row, t in zip(padded, texts, strict=True):
            row[: len(t)] = np.frombuffer(t, np.uint8)
        group = np.array([rng.randint(0, 2) for _ in texts])
        order = suffix_dedup.deep_shallow_order(group, padded, np.array([len(t) for t in texts]), shallow=2)
        assert [(group[i], texts[i]) for i in order] == sorted(zip(group.tolist(), texts, strict=True))


def test_substring_dedup_on_awkward_rows(spark, awkward):
    got = suffix_dedup.substring_dedup(make(spark, awkward), keep_text=True).collect()
    assert len(got) == len(awkward)
    one = {r.doc_id: r for r in got}
    assert one[5].n_removed == 5000 - 99 or one[5].n_removed > 0
    assert one[1].n_bytes == 0 and one[6].n_removed == 0
    assert suffix_dedup.substring_dedup(make(spark, [])).count() == 0
    kept = suffix_dedup.without_repeats(make(spark, [(1, "é" * 80, "fr", "s", 80), (2, "x" + "é" * 80, "fr", "s", 81)])).collect()
    assert all(r.n_chars == len(r.text) for r in kept)


def brute_components(docs):
    f = [simhash.fingerprint((t or "").encode()) for _, t, *_ in docs]
    label = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i in range(len(docs)):
            for j in range(len(docs)):
                if (f[i] ^ f[j]).bit_count() <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    low = {}
    for k, (d, *_) in zip(label, docs, strict=True):
        low[k] = d if low.get(k) is None else low[k] if d is None else min(low[k], d)
    return [(d, f"{x:016x}", low[k]) for (d, *_), x, k in zip(docs, f, label, strict=True)]


@pytest.mark.parametrize("kind", ["small", "awkward"])
def test_simhash(spark, kind, request):
    docs = request.getfixturevalue(kind)
    got = rows_of(simhash.simhash_components(make(spark, docs)), "doc_id", "fingerprint", "component_id")
    assert got == by(brute_components(docs))


def test_simhash_definition():
    import xxhash

    text = "A b  C d\te f"
    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert simhash.fingerprint(b" ") == 0


def test_long_chains_of_links(spark):
    from recordloom.llm.graph import components

    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages_keep_columns(spark, small, labels, benchmark_items):
    docs = clashing(spark, small)
    items = spark.createDataFrame(benchmark_items, "item_id long, text string")
    for out in (quality.good_documents(docs, labels), simhash.keep_one(docs), suffix_dedup.without_repeats(docs), decontam.decontaminated(docs, items)):
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert all(r.row == "r" and r.copy == 9 for r in out.collect())
    mixed = mixing.mixed_documents(docs)
    assert set(mixed.columns) == set(docs.columns) and mixed.count() == sum(r.copies for r in mixing.mix(docs).collect())


def test_keep_one_on_awkward_rows(spark, awkward):
    left = simhash.keep_one(make(spark, awkward)).collect()
    named = [(k, t) for k, (_, t, *_) in enumerate(awkward)]
    texts = {k: t for k, t in named}
    firsts = {c for _, _, c in brute_components(named)}  # a component is one of texts, whatever their ids
    assert len(left) == len(firsts) and {simhash.fingerprint((r.text or "").encode()) for r in left} == {simhash.fingerprint((texts[k] or "").encode()) for k in firsts}

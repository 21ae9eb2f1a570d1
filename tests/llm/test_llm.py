"""Operators against brute force on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafweave.llm import anchors, collection_bwt, decontaminate, kd_shards, packing, pii, quality_rules, similar, simhash, suffix_trees, token_files, tokens, warc, workdir

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, start long, key string"


def rows(seed=5, n=60):
    random.seed(seed)
    vocabulary = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 5))) for _ in range(30)]

    def prose(k):
        return " ".join(random.choice(vocabulary) for _ in range(k))

    shared = [prose(25), prose(40)]
    texts = [None, "", " \n\t ", "x", "aa " * 300, "日本 語。 " * 30]
    for i in range(n):
        texts.append(prose(random.randint(0, 60)) + (" \n" + random.choice(shared) + "  " if i % 3 == 0 else "") + prose(random.randint(0, 20)))
    texts += texts[-5:] * 3
    return [(i, t, "en" if i % 2 else None, f"s{i % 3}", 7, "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("limit", [500, 1])
def test_suffix_trees(table, empty, limit):
    seen, want = set(), {}
    for i, t, *_ in rows():
        w = re.findall(WORD, t or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in suffix_trees.dedup(table, key_pieces=limit).collect()}
    assert got == want
    assert suffix_trees.dedup(empty).count() == 0


@pytest.mark.parametrize("limit", [500, 1])
def test_collection_bwt(table, empty, limit):
    window, counts = 40, Counter()
    data = {i: (t or "").encode() for i, t, *_ in rows()}
    for b in data.values():
        counts.update(b[s : s + window] for s in range(len(b) - window + 1))
    want = {}
    for i, b in data.items():
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - window + 1):
            if counts[b[s : s + window]] > 1:
                gone[s : s + window] = True
        want[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), bytes(x for x, g in zip(b, gone) if not g))
    out = collection_bwt.dedup(table, window=window, gram=16, key_pieces=limit).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out} == want
    assert collection_bwt.dedup(empty).count() == 0


def test_equal_spans_are_told_by_symbols(monkeypatch):
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 5000).astype(np.uint8)
    one, two, size = (rng.integers(0, 4900, 3000) for _ in range(3))
    size = size % 12
    want = [bytes(text[a : a + n]) == bytes(text[b : b + n]) for a, b, n in zip(one, two, size)]
    for most in (1, 100, 1 << 20):
        monkeypatch.setattr(anchors, "_COMPARED", most)
        assert anchors.alike(text, one, two, size).tolist() == want


@pytest.mark.parametrize("limit", [1, 7, 10_000])
def test_subtrees_by_prefixes(limit):
    """Groups of any size give the classes that sorting all windows gives."""
    rng = np.random.default_rng(3)
    text, depth = rng.integers(1, 4, 400).astype(np.uint32), 5
    at = np.arange(len(text) - depth + 1)
    want = Counter(tuple(text[i : i + depth]) for i in at)
    got = {}
    for group in suffix_trees.prefix_groups(text, at, depth, limit):
        leaves, lcp = suffix_trees.subtree(text, group, depth)
        for deep, lo, hi in suffix_trees.internal_nodes(lcp, depth):
            got[tuple(text[leaves[lo] : leaves[lo] + depth])] = hi - lo + 1
            assert deep == depth
    assert got == {k: n for k, n in want.items() if n > 1}


def test_bwt_order():
    random.seed(3)
    for _ in range(60):
        strings = [bytes(random.choice(b"ab") for _ in range(random.randint(0, 20))) for _ in range(random.randint(1, 5))]
        _, lcp, owner, length = collection_bwt.build(strings, in_memory=64)
        order = sorted(([c + 1 for c in x[len(x) - k :]] + [0, i], i, k) for i, x in enumerate(strings) for k in range(len(x) + 1))
        assert [(i, k) for _, i, k in order] == list(zip(owner.tolist(), length.tolist()))


def test_simhash(table, empty, spark):
    out = {r.doc_id: r for r in simhash.near_duplicates(table).collect()}
    prints = {i: int(r.fingerprint, 16) for i, r in out.items()}
    assert all(prints[i] == simhash.fingerprint((t or "").encode()) for i, t, *_ in rows())
    root = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            root[i] = min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4)
    assert {i: r.component_id for i, r in out.items()} == root
    assert simhash.near_duplicates(empty).count() == 0
    assert {r.doc_id for r in simhash.representatives(table).collect()} == set(root.values())


def test_pipeline_near_copies(spark, table, empty):
    import corpus_pipeline

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    docs = []
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(120, 400))]
        docs.append((10 * i, " ".join(words)))
        for k in range(1, 5):
            copy = list(words)
            for at in rng.sample(range(len(copy)), max(1, len(copy) * k // 100)):
                copy[at] = rng.choice(vocabulary)
            docs.append((10 * i + k, " ".join(copy)))
    docs += [(9000, "X " + docs[0][1].upper()), (9001, None), (9002, ""), (9003, "two words"), (9003, docs[7][1]), (None, docs[0][1])]

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, grams(t)) for i, t in docs if i is not None]
    root = [i for i, _ in sets]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if (not sets[a][1] and not sets[b][1]) or len(sets[a][1] & sets[b][1]) >= 0.8 * max(1, len(sets[a][1] | sets[b][1]))]
    assert len(near) > 80
    for _ in range(12):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.component_id) for r in similar.near_duplicates(frame).collect() if r.doc_id is not None)
    assert got == sorted((i, r) for (i, _), r in zip(sets, root))
    gone = {i for (i, _), r in zip(sets, root) if i != r}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()} == {i for i, _ in docs} - gone
    assert similar.near_duplicates(empty).count() == 0


def test_links_split_alike():
    random.seed(1)
    values = list({c ^ sum(1 << random.randrange(64) for _ in range(random.randint(0, 2))) for c in [random.getrandbits(64) for _ in range(10)] for _ in range(15)})

    def roots(pairs):
        r = list(range(len(values)))

        def find(i):
            while r[i] != i:
                i = r[i]
            return i

        for i, j in pairs:
            a, b = find(i), find(j)
            r[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(values))]

    near = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4]
    assert roots(near) == roots(simhash.links(values)) == roots(simhash.links(values, limit=5))


def plain_ids(text):
    """Ids by the library alone, with the end id."""
    from tokenizers import Tokenizer

    if not hasattr(plain_ids, "tokenizer"):
        plain_ids.tokenizer = Tokenizer.from_file(tokens.default_vocabulary())
    return [*plain_ids.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def with_nulls(spark, table):
    """The table with two rows without an id, a repeated row, a long text and columns that operators use themselves."""
    more = [(None, "no id", "en", "s0", 1, "k"), (None, None, None, None, None, None), (7, "x", "en", "s1", 2, "k"), (7, "x", "en", "s1", 2, "k"), (900, "word " * 40_000, "en", "s1", 3, "k"), (901, "end <|endoftext|> mark<|endoftext|>", "en", "s1", 3, "k")]
    return table.unionByName(spark.createDataFrame(more, SCHEMA)), [(i, t) for i, t, *_ in rows()] + [(i, t) for i, t, *_ in more]


def test_token_files(spark, table, empty):
    vocabulary = tokens.default_vocabulary()
    docs, plain = with_nulls(spark, table)
    order = sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = [(i, plain_ids(t)) for i, t in order]
    starts = np.cumsum([0, *[len(x) for _, x in want]])[:-1].tolist()
    manifest = token_files.write(docs, workdir.new_folder(spark, "t"), vocabulary)
    got = token_files.read(manifest).orderBy("start").collect()
    assert [(r.doc_id, list(r.ids)) for r in got] == want and [r.start for r in got] == starts
    digests = token_files.digests(manifest).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in digests] == [(i, s, len(x), crc(x)) for (i, x), s in zip(want, starts)]
    part = manifest.first()
    ids, own, offsets = token_files.open_part(part["path"], part["n_docs"], part["width"])
    assert isinstance(ids, np.memmap) and offsets[-1] == part["n_ids"] == len(ids) and len(own) == part["n_docs"]
    assert token_files.write(empty, workdir.new_folder(spark, "t"), vocabulary).count() == 0


def test_packing(spark, table, empty):
    vocabulary, docs = tokens.default_vocabulary(), with_nulls(spark, table)
    pieces = packing.pieces(docs[0], vocabulary, sequence=64)
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces.collect())
    want = Counter()
    for i, t in docs[1]:
        ids = plain_ids(t)
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want.update((i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert got == want
    named = pieces.withColumn("sequence_id", F.lit(5)).withColumn("_at", F.col("start"))
    packed = packing.pack(workdir.cut(named), sequence=64, open_bins=8, task_pieces=200, block=16)
    assert packed.columns[-5:] == ["ids_crc32", "sequence_id_", "_at", "sequence_id", "offset"]
    rows_ = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows_) == want and all(r["_at"] == r.start and r["sequence_id_"] == 5 for r in rows_)
    at = {}
    for r in sorted(rows_, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 64
    assert packing.pack(packing.pieces(empty, vocabulary)).count() == 0


def test_best_fit_equals_model():
    """Against a plain list of open bins: the fullest that fits, else a new one; one too many closes the fullest."""
    rng = random.Random(6)
    for _ in range(60):
        most, size = rng.randint(1, 6), rng.randint(5, 40)
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 120))]
        fit = packing.BestFit(size, most)
        bins, offsets = fit.place(lengths[:50])
        more = fit.place(lengths[50:])
        bins, offsets = bins + more[0], offsets + more[1]
        free, opened, closed = {}, 0, 0
        for n, b, o in zip(lengths, bins, offsets):
            fitting = [f for f in free.values() if f >= n]
            if fitting:
                assert free[b] == min(fitting) and o == size - free[b]
            else:
                assert b == opened and o == 0
                opened += 1
                if len(free) == most:
                    # of equally full bins any may close: take one that isn't used again
                    fullest = [x for x in free if free[x] == min(free.values())]
                    later = set(bins[bins.index(b):])
                    free.pop(next((x for x in fullest if x not in later), fullest[0]))
                    closed += 1
                free[b] = size
            free[b] -= n
            if not free[b]:
                del free[b]
        assert (fit.opened, fit.closed) == (opened, closed)


def test_packing_needs_few_sequences():
    rng = random.Random(7)
    lengths = [min(2048, int(rng.lognormvariate(5.5, 1.1)) + 1) for _ in range(60_000)]
    blocks = [sorted(lengths[k : k + packing.BLOCK], reverse=True) for k in range(0, len(lengths), packing.BLOCK)]
    fit = packing.BestFit()
    fit.place([n for b in blocks for n in b])
    assert fit.closed > 0 or fit.n_open <= packing.OPEN_BINS
    assert fit.opened <= 1.01 * sum(lengths) / 2048


@pytest.mark.parametrize("text", ["don't stop. I'll go' x", "é×a ÷.b", "x  y  z", "a\u0085 b", "  lead\t\ttab \n", "日本 語。ok", "word's 's 'S", "a" * 300 + " b", "<|endoftext|> a", "a <|endoftext|>b.c <|end", "\x1c a\x1f b"])
def test_encoder_cuts(text):
    enc = tokens.encoder(tokens.default_vocabulary())
    data = np.frombuffer((text + "x y" + text).encode(), dtype=np.uint8)
    limits = np.cumsum([0, len(text.encode()), 3, len(text.encode())])
    ids, before = enc.encode_flat(data, limits)
    assert [ids[a:b].tolist() for a, b in zip(before, before[1:])] == [plain_ids(t)[:-1] for t in (text, "x y", text)]


def test_quality(table, empty):
    got = {r.doc_id: r for r in quality_rules.quality(table).collect()}
    for i, t, *_ in rows():
        w = re.findall(WORD, t or "")
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        m = [0] * len(w)
        for k in range(len(w) - 4):
            if c[tuple(w[k : k + 5])] > 1:
                m[k : k + 5] = [1] * 5
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(m), len(w) < 10 or 100 * sum(m) > 20 * len(w))
    assert {r.doc_id for r in quality_rules.passing(table).collect()} == {i for i, r in got.items() if r.kept}
    assert quality_rules.quality(empty).count() == quality_rules.passing(empty).count() == 0


def test_common_words_reject(spark):
    rng = random.Random(4)

    def prose(lang, k):
        common = quality_rules.COMMON[lang].split()
        return " ".join(rng.choice(common) if rng.random() < 0.25 else "".join(rng.choice("aeinorst") for _ in range(rng.randint(3, 9))) for _ in range(k))

    rare = lambda k: ["".join(rng.choice("aeinorst") for _ in range(rng.randint(5, 9))) for _ in range(k)]
    clean = [(i, prose(lang, rng.randint(150, 900)), lang) for i, lang in enumerate(["en", "de"] * 100)]
    lists = [(1000 + i, " | ".join(rare(k)), "en") for i, k in enumerate((100, 120, 200, 400))]
    wrong = [(2000 + i, prose("de", k), "en") for i, k in enumerate((150, 300, 600))]
    docs = spark.createDataFrame(clean + lists + wrong, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.quality(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {i for i, *_ in lists + wrong}
    assert {r.doc_id for r in quality_rules.passing(docs).collect()} == {i for i, *_ in clean}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_pii(spark, table, empty):
    def right(k, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[k]

    random.seed(2)
    for _ in range(5000):
        x = "".join(random.choice("a1 .@+-()2é0\n%") for _ in range(random.randint(0, 40)))
        assert pii.base_spans(x) == {k: [m.span() for m in re.finditer(p, x) if right(k, m.group())] for k, p in PATTERNS.items()}
    cases = spark.createDataFrame([(1, "mail a.b@c.com or call +1 (743) 555-3824"), (2, None), (3, "")], "doc_id long, text string")
    model = pii.fit(cases)
    assert [r.text for r in pii.redact(cases, model).orderBy("doc_id").collect()] == ["mail [EMAIL] or call [PHONE]", None, ""]
    assert pii.find(empty, pii.fit(empty)).count() == 0 and pii.find(table, model).count() == table.count()
    texts = {1: "mail a.b@c.com or call +1 (743) 555-3824, 10.0.0.1", 2: None, 3: "", 4: "no", 5: "4111 1111 1111 1111 " * 2_000}
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), {}).collect()}
    for i, t in texts.items():
        want = {k: [m.span() for m in re.finditer(p, t or "") if right(k, m.group())] for k, p in PATTERNS.items()}
        joined = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k])
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in pii.KINDS) and r.spans == joined and r.n_spans == sum(map(len, want.values()))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def labelled(rng, n):
    """Texts with one loose candidate each: (text, kind, start, end, whether it is personal data or a secret)."""
    pick = rng.choice
    digits = lambda k: "".join(pick("0123456789") for _ in range(k))
    word = lambda: "".join(pick("abcdefgh") for _ in range(6))

    def card():
        while True:
            d = "4" + digits(15)
            if pii.luhn(d):
                return pick("./_").join(d[k : k + 4] for k in range(0, 16, 4))

    make = {
        ("email", True): lambda: (pick(["write to ", "mail me: ", "contact "]), f"{word()} [at] {word()} [dot] {pick(['com', 'org', 'de'])}"),
        ("email", False): lambda: (pick(["look (at) it, ", "version "]), f"{word()} [at] {word()} [dot] {word()}"),
        ("ip", True): lambda: (pick(["server ", "host ", "login from "]), "[.]".join(str(rng.randint(11, 250)) for _ in range(4))),
        ("ip", False): lambda: (pick(["version ", "section "]), "[.]".join(["0", *(str(rng.randint(0, 9)) for _ in range(3))])),
        ("card", True): lambda: (pick(["card ", "visa ", "pay with "]), card()),
        ("card", False): lambda: (pick(["section ", "isbn "]), "/".join(["9123", digits(4), digits(4), digits(4)])),
        ("phone", True): lambda: (pick(["call ", "tel ", "phone: "]), f"{pick('2345678')}{digits(2)}-{digits(3)}-{digits(4)}"),
        ("phone", False): lambda: (pick(["version ", "no. "]), f"0{digits(2)}.{digits(3)}.{digits(4)}"),
        ("secret", True): lambda: pick([("password=", f"{word()}{digits(6)}"), ("the key ", "AKIA" + "".join(pick("ABCDEFG234567") for _ in range(16)))]),
        ("secret", False): lambda: ("password: ", pick(["changeme", "required", "optional"])),
    }
    out = []
    for _ in range(n):
        (kind, good), f = pick(list(make.items()))
        head, span = f()
        before = " ".join(word() for _ in range(9)) + " "
        out.append((before + head + span + " " + word(), kind, len(before + head), len(before + head + span), good))
    return out


def test_added_spans_on_held_out_texts(spark):
    """Precision and recall of what the classifier adds, trained without labels on other texts."""
    rng = random.Random(11)
    train, held_out = labelled(rng, 2500), labelled(rng, 1500)
    strict = [f"mail {k}.a@b.com card 4111 1111 1111 1111 server 10.1.2.{k} call +1 743 555 38{k:02d}" for k in range(60)]
    model = pii.fit(spark.createDataFrame([(t,) for t in [*strict, *(x[0] for x in train)]], "text string"))
    assert set(model) == set(pii.ALL_KINDS)
    for kind in pii.ALL_KINDS:
        added = [((k, s, e) in pii.spans(t, model), good) for t, k, s, e, good in held_out if k == kind]
        right = sum(a and g for a, g in added)
        assert right >= 0.9 * sum(g for _, g in added), kind  # recall
        assert right >= 0.95 * sum(a for a, _ in added), kind  # precision


def test_em_finds_reliabilities():
    """Votes drawn from known reliabilities: the estimates come near them."""
    rng = random.Random(5)
    sure, counts = (0.95, 0.8, 0.65), Counter()
    for _ in range(20_000):
        truth = 1 if rng.random() < 0.6 else -1
        counts[tuple(truth if rng.random() < p else -truth for p in sure)] += 1
    prior, table, post = pii.em(counts, rounds=300)
    assert abs(prior - 0.6) < 0.05 and all(abs(table[k, 1, 2] - p) < 0.05 and abs(table[k, 0, 0] - p) < 0.05 for k, p in enumerate(sure))
    assert post[1, 1, 1] > 0.95 and post[-1, -1, -1] < 0.05


def test_decontaminate(spark, table, empty):
    random.seed(9)
    item = " ".join("".join(random.choice("klmnop") for _ in range(6)) for _ in range(30))
    near = item.replace(item.split()[12], "zz", 1)
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "a few words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "intro " + item.upper() + " tail"), (2, "x " * 50 + near), (3, None), (4, ""), (5, "other words"), (6, "so A few, words!"), (1, item)], "doc_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (1, 1), (2, 1), (6, 4)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [3, 4, 5]
    assert decontaminate.contaminated(empty, items).count() == 0 and decontaminate.clean(table, items).count() == table.count()


def found_share(size, change, n=40, vocabulary=3000):
    """Share of items found in texts that hold a changed copy of them."""
    rng = random.Random(size)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(vocabulary)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    items = [(i, prose(size)) for i in range(n)]
    texts = [f"{prose(60)} {change(t, rng)} {prose(60)}" for _, t in items]
    got = decontaminate.hits(decontaminate.Index(items), decontaminate.pa.array(texts))
    return sum(row == item for row, item, *_ in got) / n


@pytest.mark.parametrize("size", [4, 6, 9, 13, 20, 40, 80])
@pytest.mark.parametrize("share", [0.02, 0.08, 0.12, 0.15, 0.2])
def test_decontaminate_typos(size, share):
    def typos(text, rng):
        out = list(text)
        for k in rng.sample(range(len(out)), int(share * len(out))):
            out[k] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        return "".join(out)

    assert found_share(size, typos) >= (0.95 if share < 0.2 else 0.9)


def naive_distance(item, text):
    """Least edit distance of the item to any part of the text, by the table of all prefixes."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_decontaminate_equals_exhaustive_search():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    items = [(i, prose(k)) for i, k in enumerate((1, 2, 4, 7, 12, 20, 35))] + [(20, "Äußerst, übel!"), (21, "--"), (22, "x")]
    texts = []
    for n in range(25):
        parts = [prose(rng.randint(0, 20))]
        for _, t in rng.sample(items, 2):
            out = list(t)
            for _ in range(rng.randint(0, max(0, int(0.25 * len(out))))):
                k = rng.randrange(len(out))
                out[k : k + 1] = rng.choice([[], [rng.choice("abcxyz ")], [out[k], rng.choice("abcxyz")]])
            parts += ["".join(out).upper() if n % 4 == 0 else "".join(out), prose(rng.randint(0, 20))]
        texts.append(" ".join(parts))
    index = decontaminate.Index(items)
    got = {(row, item): d for row, item, d, *_ in decontaminate.hits(index, decontaminate.pa.array(texts))}
    plain = lambda t: " ".join(w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or w for w in t.lower().split())
    want = {(n, i): d for n, t in enumerate(texts) for i, x in items if (d := naive_distance(plain(x), plain(t))) <= 0.2 * len(plain(x)) + 1e-9}
    assert set(got) <= set(want) and len(set(want) - set(got)) <= 0.05 * len(want), set(want) - set(got)
    assert all(got[k] == want[k] for k in got)
    assert len(want) > 60


@pytest.mark.parametrize("size, more", [(55, 9), (100, 16), (150, 25)])
def test_decontaminate_insertion(size, more):
    def longer(text, rng):
        words, half = text.split(), size // 2
        out = " ".join([*words[:half], *rng.sample(words, more), *words[half:]])
        return out if len(out) - len(text) <= 0.2 * len(text) else text

    assert found_share(size, longer, 12) == 1


@pytest.mark.parametrize("size", [5, 8, 10, 12])
def test_decontaminate_short(size):
    def replaced(text, rng):
        words = text.split()
        words[rng.choice([k for k, w in enumerate(words) if len(w) <= 0.2 * len(text)] or [0])] = "zq"
        return " ".join(words)

    assert found_share(size, replaced, 150) >= 0.97


@pytest.mark.parametrize("shards", [1, 5])
def test_shards(spark, table, empty, shards):
    docs, plain = with_nulls(spark, table)
    got = kd_shards.shard(docs, shards=shards).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in plain)
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in got)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert kd_shards.shard(empty, shards=shards).count() == 0


def test_shards_are_near_equal(spark):
    rng = random.Random(4)
    docs = [(i, "x" * min(4000, int(rng.lognormvariate(5, 1))), rng.choice(["en", "de"]), f"s{rng.randrange(9)}") for i in range(6000)] + [(10_000 + i, "equal text " * 20, "en", "s1") for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(6)
    total = sum(len(t) + 1 for _, t, *_ in docs)
    for given in ({"shards": 8}, {"target_bytes": total // 20}):
        sums = Counter()
        for r in kd_shards.shard(frame, **given).collect():
            sums[r.shard] += r.size
        n = given.get("shards") or -(-total // given["target_bytes"])
        assert len(sums) == n and max(sums.values()) - min(sums.values()) <= 0.02 * total / n + 2 * 4001


def test_tree_cuts_at_weighted_medians(spark):
    """Against a plain recursion that sorts: same cuts, as far as the histograms promise."""
    rng = np.random.default_rng(8)
    keys = rng.integers(0, 1 << 62, (2, 3000))
    sizes = rng.integers(1, 500, 3000)
    rows_ = spark.createDataFrame([(int(s), int(a), int(b)) for s, a, b in zip(sizes, *keys)], "size long, k0 long, k1 long").repartition(4)
    tree = kd_shards.grow(rows_, 2, 8)
    leaf = tree.leaf(list(keys))
    for node in np.flatnonzero(tree.left >= 0):
        inside = np.ones(len(sizes), dtype=bool)  # rows under the node, by walking up
        at, child = int(node), None
        while at:
            parent = int(np.flatnonzero((tree.left >= 0) & ((tree.left == at) | (tree.left == at - 1)) & (tree.left <= at))[-1])
            side = keys[tree.dim[parent]] > tree.cut[parent]
            inside &= side if at > tree.left[parent] else ~side
            at = parent
        total, below = sizes[inside].sum(), sizes[inside & (keys[tree.dim[node]] <= tree.cut[node])].sum()
        assert abs(below - total / 2) <= 500 + kd_shards.EXACT * total
    assert len(set(leaf)) == 8


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<html><title>T</title><p>Hi <a href='/x'>there</a><script>no</script></p><p>you</p>"), (2, None, None)], "page_id long, url string, html string")
    source = {r.record_id: r for r in warc.responses(pages).collect()}
    got = warc.derivatives(pages).collect()
    assert Counter(r.type for r in got) == {"metadata": 2, "conversion": 2}
    for r in got:
        assert r.headers["WARC-Refers-To"] in source and r.headers["WARC-Block-Digest"] == warc.digest(bytes(r.block))
        assert r.headers["WARC-Source-Payload-Digest"] == source[r.headers["WARC-Refers-To"]].headers["WARC-Payload-Digest"]
    assert any(bytes(r.block) == b"Hi there\nyou" for r in got)
    assert warc.derivatives(pages.where("page_id < 0")).count() == 0


def test_warc_files_of_others(spark, tmp_path):
    """Version 1.0, members or plain, any case, repeated headers, a broken end."""
    import gzip

    def record(n, body, version="1.0"):
        return (f"WARC/{version}\r\nwarc-type: response\r\nWARC-Record-ID: <urn:{n}>\r\nWARC-Date: d\r\nWARC-Target-URI: http://{n}/\r\nWARC-Concurrent-To: a\r\nWARC-Concurrent-To: b\r\ncontent-length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"

    page = "<p>é &amp; x</p>".encode("latin-1")
    packed = gzip.compress(page)
    chunked = b"".join(f"{len(packed[k : k + 7]):x}\r\n".encode() + packed[k : k + 7] + b"\r\n" for k in range(0, len(packed), 7)) + b"0\r\n\r\n"
    plain = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n" + page
    coded = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked
    whole = [record(1, plain), record(2, coded, "1.1"), record(3, b"")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, whole)))
    (tmp_path / "b.warc").write_bytes(b"".join(whole))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(map(gzip.compress, whole[:2])) + gzip.compress(record(4, plain))[:60])
    for name, n in (("a.warc.gz", 3), ("b.warc", 3), ("c.warc.gz", 2)):
        found = warc.read(spark.createDataFrame([(f"file://{tmp_path}/{name}",)], "path string"))
        rows_ = sorted(found.collect(), key=lambda r: r.record_id)
        assert [r.record_id for r in rows_] == [f"<urn:{k}>" for k in range(1, n + 1)]
        assert rows_[0].headers["WARC-Concurrent-To"] == "a, b" and bytes(rows_[0].block) == plain
        made = [bytes(r.block).decode() for r in warc.derive(found).collect() if r.type == "conversion"]
        assert made.count("é & x") == 2


def test_warc_tokens_equal_parser():
    rng = random.Random(5)
    bits = ['<p>', "</p>", '<script>var t="</p>";</script>', "<script>", "<style>p{}</style>", "<title>a &amp; b</title>", "x y", " &amp; ", "&lt", "<A HREF=u>", '<a x href="q&amp;r">', "<a href=''>", "</a>", "<!-- ad -->", "<!--->", "<br/>", "\n", '<div id="1">', "</div >", "<noscript>", "</noscript>", "<template/>", "<", "&copy", "<textarea>", "</title>"]
    split = 0
    for _ in range(5000):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        page = warc._Page()
        page.feed(html)
        page.close()
        got = warc._read(html)
        assert ("".join(got.text).split(), "".join(got.title), got.links) == ("".join(page.text).split(), "".join(page.title), page.links), html
        split += "<" not in "".join(warc._TOKEN.split(html)[::5])
    assert 500 < split < 4500


CLASH = ("fp", "label", "node", "root", "k0", "d0", "n", "weight", "sequence_id", "offset", "length", "piece", "place", "copies", "rivals", "state", "set_key", "bands", "component_id", "size", "shard", "text_key", "item_id", "kept", "part", "asked", "ranges", "_at")


@pytest.fixture(scope="module")
def awkward(spark, table):
    """Nulls in every column, empty, very long and repeated texts, shared ids, and columns that operators use themselves."""
    docs, plain = with_nulls(spark, table)
    docs = docs.union(spark.createDataFrame([(950, "é" * 200_000, "fr", None, None, None), (951, "a b " * 60_000, None, "s", 1, None), (952, "# " * 50, "xx", "s", 1, None)], SCHEMA))
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("clash"))
    return docs.repartition(4), [*plain, (950, "é" * 200_000), (951, "a b " * 60_000), (952, "# " * 50)]


def test_awkward_rows(spark, awkward):
    docs, plain = awkward
    ids = Counter(i for i, _ in plain)
    items = spark.createDataFrame([(1, "word word word word"), (2, None), (None, "x"), (3, "")], "item_id long, text string").withColumn("fp", F.lit(1))
    by_id = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    assert by_id(simhash.near_duplicates(docs)) == by_id(similar.near_duplicates(docs)) == ids
    assert by_id(quality_rules.quality(docs)) == by_id(pii.find(docs, pii.fit(docs))) == by_id(kd_shards.shard(docs, shards=3)) == ids
    assert by_id(suffix_trees.dedup(docs)) == by_id(collection_bwt.dedup(docs, window=40, gram=16)) == ids
    vocabulary = tokens.default_vocabulary()
    assert by_id(token_files.digests(token_files.write(docs, workdir.new_folder(spark, "t"), vocabulary))) == ids
    packed = packing.pack(workdir.cut(packing.pieces(docs, vocabulary)))
    assert by_id(packed.where("piece = 0")) == ids
    assert {r.doc_id for r in decontaminate.contaminated(docs, items).collect()} == {900}
    # stages keep all columns, and rows that nothing speaks against
    for out in (quality_rules.passing(docs), similar.representatives(docs), simhash.representatives(docs), decontaminate.clean(docs, items), pii.redact(docs, {})):
        assert out.columns == docs.columns and set(by_id(out)) <= set(ids)
    assert by_id(decontaminate.clean(docs, items)) == ids - Counter([900])
    assert by_id(pii.redact(docs, {})) == ids


def test_long_texts(spark):
    """Texts of 60,000 words with shared passages, against brute force."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(400))
    docs = []
    for i in range(3):
        w = [word() for _ in range(20_000)]
        docs.append((i, " ".join(w[:7000]) + " " + passage + "\n" + " ".join(w[7000:]) + " " + passage[: 900 + 700 * i]))
    seen, want = set(), {}
    for i, t in docs:
        w = t.split()
        gone = np.zeros(len(w), dtype=bool)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = True
            seen.add(g)
        want[i] = (len(w), int(gone.sum()))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_words, r.n_removed) for r in suffix_trees.dedup(frame).collect()} == want and want[2][1] > 400
    data = {i: t.encode() for i, t in docs}
    counts = Counter(b[k : k + 200] for b in data.values() for k in range(len(b) - 199))
    got = {r.doc_id: r.n_removed for r in collection_bwt.dedup(frame).collect()}
    for i, b in data.items():
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 199):
            if counts[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        assert got[i] == int(gone.sum()) > 2000


def test_pipeline(spark, tmp_path):
    """Every stage against brute force on what the stage before it kept."""
    import corpus_pipeline

    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghijklmn") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    items = [(i, prose(rng.randint(8, 25))) for i in range(4)]
    docs = [(i, prose(rng.randint(25, 120))) for i in range(60)]
    docs += [(100, "too short"), (101, None), (102, ""), (103, "one two three four five six " * 8)]
    docs += [(110 + i, " ".join("zz" if k == 7 else w for k, w in enumerate(docs[i][1].split()))) for i in range(8)] + [(130, docs[3][1]), (131, docs[3][1].upper())]
    near = list(items[1][1])
    near[3] = near[-4] = "q"
    docs += [(140, prose(20) + " " + items[0][1].upper() + " " + prose(9)), (141, prose(30) + " " + "".join(near) + " " + prose(12))]
    docs += [(150, prose(12) + " a.b@c.com " + prose(8) + " 10.2.3.4"), (151, prose(15) + " +1 (743) 555-3824 zz 4111 1111 1111 1111 " + prose(6)), (152, prose(3000))]
    spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, columns = dict(docs), held.columns

    def passes(t):
        w = (t or "").split()
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(5)}
        return len(w) >= 10 and 100 * len(again) <= 20 * len(w)

    def roots(rows_):
        sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows_.items()}
        root = {i: i for i in sets}
        for _ in range(4):
            for a in sets:
                for b in sets:
                    if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                        root[a] = root[b] = min(root[a], root[b])
        return {i for i in root if root[i] == i}

    plain = lambda t: " ".join(w.strip("!,.") for w in t.lower().split())

    def redacted(t):
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        fits = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda m: 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
        for kind, p in PATTERNS.items():
            t = re.sub(p, lambda m, kind=kind: f"[{kind.upper()}]" if fits[kind](m) else m.group(), t)
        return t

    want = [lambda r: {i: t for i, t in r.items() if passes(t)}, lambda r: {i: t for i, t in r.items() if i in roots(r)}, lambda r: {i: t for i, t in r.items() if all(naive_distance(plain(x), plain(t)) > 0.2 * len(x) for _, x in items)}, lambda r: {i: redacted(t) for i, t in r.items()}]
    for (name, stage), then in zip(corpus_pipeline.STAGES, want):
        out = stage(spark, held, str(tmp_path))
        assert out.columns == columns, name
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        held, kept = spark.read.parquet(path), then(kept)
        rows_ = held.collect()
        assert {r.doc_id: r.text for r in rows_} == kept and len(rows_) == len(kept), name
        assert all(r.n_chars == len(r.text) for r in rows_)
    assert {100, 101, 102, 103, 110, 130, 131, 140, 141}.isdisjoint(kept) and len(kept) > 55 and "[CARD]" in kept[151]
    final = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    expected = Counter()
    for i, t in kept.items():
        ids = plain_ids(t)
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        expected.update((i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert final == expected

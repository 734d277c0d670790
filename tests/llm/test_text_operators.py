"""Quality, secrets, tokens, packing, mixing and near-duplicates, against plain Python."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewise.llm import mixing, packing, prefix_counts, quality, secrets, simhash, toxicity
from tracewise.llm.text import WordTokens, tokenizer, word_blocks

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "the end. " * 20_000
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, source="s"):
    rows = [(i, t, "en", source, len(t) if t else 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Quality rules.


def repeated(text):
    w = plain_words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    places = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(places)


def test_ledger_counts_equal_plain_python(spark):
    texts = [None, "", " \n\t ", "a b c a b c", "a a a a", "x y", "l1 w\n\nl1 w\nl2\n l2", "É#É !a| \x1cb", LONG]
    for r in quality.ledger(documents(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        lines = [x for x in t.split("\n") if plain_words(x)]
        assert (r.n_words, r.n_repeat_words) == (len(plain_words(t)), repeated(t))
        assert r.word_chars == sum(map(len, plain_words(t)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert (r.n_lines, r.n_dup_lines) == (len(lines), len(lines) - len(set(lines)))


def test_bits_policies_and_ablation(spark):
    good = " ".join(f"word{i} of{i}" for i in range(60))
    frame = documents(spark, ["too short", good, good.replace(" ", "### "), None]).withColumn("failed", F.lit("old"))
    rows = quality.ledger(frame).withColumn("kept", ~quality.rejects("v1"))
    assert [r.kept for r in rows.orderBy("doc_id").collect()] == [False, True, False, False]
    told = {r.rule: r for r in quality.ablation(rows, "v1").collect()}
    assert told["too_few_words"].fails == 2 and told["too_few_words"].kept_without == 3
    assert (told["symbols"].fails, told["symbols"].fails_alone) == (1, 1)
    assert quality.mask("base") == 3
    assert quality.ablation(rows.limit(0), "v1").filter("fails > 0").count() == 0


def test_filter_on_the_ledger_stays_above_the_measurements(spark):
    plan = quality.ledger(documents(spark, ["a"])).filter(~quality.rejects("v1"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Filter") < text.index("Generate")


# Secrets.


def test_secrets_are_found_and_other_long_words_are_not(spark):
    rnd = random.Random(1)
    hexes = ["".join(rnd.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    texts = [f'here the token = "{h}" is kept and then some' for h in hexes]
    texts += [f"extraordinarilylongwords{'abcdefgh'[i % 8]} number 49302948203948203 in plain sentences" for i in range(60)]
    texts += [None, "", "short", LONG, texts[0]]
    frame = documents(spark, texts).withColumn("length", F.lit(1))
    found = secrets.scan(frame).filter("is_secret").select("doc_id", "candidate").collect()
    assert {(r.doc_id, r.candidate) for r in found} == {(i, h) for i, h in enumerate(hexes)} | {(94, hexes[0])}
    cleaned = {r.doc_id: r for r in secrets.redact(frame).collect()}
    assert len(cleaned) == len(texts)
    for i, t in enumerate(texts):
        want = t and re.sub(r"[0-9a-f]{40}", "[SECRET]", t)
        assert cleaned[i].text == want and (i >= 30 or cleaned[i].n_chars == len(want))


def test_secrets_without_labels_of_both_kinds(spark):
    assert secrets.scan(documents(spark, ["", None])).count() == 0
    assert secrets.scan(documents(spark, []).limit(0)).count() == 0
    (row,) = secrets.scan(documents(spark, ["averyveryverylongword"])).collect()
    assert (row.probability, row.is_secret) == (0.0, False)


# SimHash.


def plain_fingerprint(text):
    w = [x.encode() for x in plain_words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "A b", "a B c", "É x Y z É x", "a b c d e f a b c", "w " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_does_not_depend_on_blocks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    want = plain_fingerprint(text)
    monkeypatch.setattr("tracewise.llm.text.BLOCK", 100)
    assert len(list(word_blocks(text.encode()))) > 100
    assert simhash.fingerprint(text) == want


def brute_links(numbers, distance):
    return {(a, b) for a in numbers for b in numbers if a < b and 0 < (a ^ b).bit_count() <= distance}


@pytest.mark.parametrize("pairwise", [512, 2])
def test_links_equal_brute_force(spark, pairwise):
    rnd = random.Random(2)
    numbers = {rnd.getrandbits(64) for _ in range(60)}
    for n in list(numbers):
        for k in (1, 2, 3):
            numbers.add(n ^ sum(1 << b for b in rnd.sample(range(64), k)))
    numbers |= {1 << b for b in range(64)} | {0}
    signed = {n - (1 << 64) if n >> 63 else n for n in numbers}
    nodes = spark.createDataFrame([(n,) for n in signed], "fp bigint")
    got = {(r.a, r.b) for r in simhash.links(nodes, 2, pairwise=pairwise).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() in (1, 2)}
    assert got == want


def test_components_on_documents(spark):
    texts = [f"{c} unique text number {i} with words {i * 7}" for i, c in enumerate("abcdef")]
    texts = texts + [texts[2], None, "", " ", texts[2], "one", "ONE", texts[5].upper()]
    frame = documents(spark, texts).withColumn("fp", F.lit("x"))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        least = [min(least[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 2) for p in prints]
    assert got == dict(enumerate(least))
    assert simhash.near_duplicates(documents(spark, []).limit(0)).count() == 0


def test_a_chain_is_one_component(spark):
    from tracewise.llm.common import connected_components

    rnd = random.Random(4)
    path = list(range(200))
    rnd.shuffle(path)
    edges = list(zip(path, path[1:])) + [(500 + i, 1000) for i in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint"), "t").collect()}
    assert got == {**dict.fromkeys(path, 0), **{500 + i: 500 for i in range(50)}, 1000: 500}


# Tokens.


def strange_texts(n=400, seed=5):
    rnd = random.Random(seed)
    parts = [" ", "  ", "\n", "a", "The", "ing", "'", "re", "ll", "s", "é", "É", "1", "23", ".", ",", "!",
             "<|endoftext|>", "\t", "\x0b", "漢", "\x1c", "İ", "\xa0", "Q", "\0"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_word_tokens_equal_the_library():
    texts, own = strange_texts(), WordTokens("word_bpe_49k.json", remember=50)
    for text, e in zip(texts, tokenizer("word_bpe_49k.json").encode_batch(texts, add_special_tokens=False)):
        assert own.of(text.encode()) == b"".join(i.to_bytes(4, "little") for i in e.ids)


def test_words_of_letters_and_marks_equal_the_library():
    rnd = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz" * 3 + "\u00DF\u00E0\u00E9\u00EF\u00F1\u00F6\u00F7\u00F8\u00FC\u00FF\u0301\u00C9Q"
    marks = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12))) + "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 3)))
             for _ in range(5000)]
    own = WordTokens("word_bpe_49k.json")
    for word, e in zip(words, tokenizer("word_bpe_49k.json").encode_batch(words, add_special_tokens=False)):
        assert own.of(word.encode()) == b"".join(i.to_bytes(4, "little") for i in e.ids), word


def test_tokenizers_of_another_kind_are_refused():
    with pytest.raises(ValueError):
        WordTokens("byte_bpe_50k.json")


def test_prefix_counts_equal_the_library_at_every_prefix():
    own, library = prefix_counts.PrefixCounts("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.json")
    for text in [*strange_texts(150, 6), "I'll say they've", "x" * 300, " \n\n  end  "]:
        prefixes = [text[: k + 1] for k in range(len(text))]
        want = [len(e.ids) for e in library.encode_batch(prefixes, add_special_tokens=False)]
        assert own.of(text).tolist() == want


def test_prefix_tokens_answer_questions(spark):
    texts = [None, "", "hello wonderful world", LONG]
    frame = documents(spark, texts).withColumn("prefix_tokens", F.lit(0))
    rows = prefix_counts.with_prefix_tokens(frame, "byte_bpe_50k.json")
    c = F.col("prefix_tokens")
    got = rows.select("doc_id", F.size(c).alias("n"), prefix_counts.tokens_in(c).alias("all"),
                      prefix_counts.tokens_in(c, 5).alias("five"), prefix_counts.longest_prefix(c, 2).alias("two")).orderBy("doc_id").collect()
    library = tokenizer("byte_bpe_50k.json")
    for r in got:
        t = texts[r.doc_id] or ""
        count = lambda x: len(library.encode(x, add_special_tokens=False).ids)
        assert (r.n, r["all"], r.five) == (len(t), count(t), count(t[:5]))
        if len(t) < 100:
            assert r.two == max((k for k in range(len(t) + 1) if count(t[:k]) <= 2), default=0)


# Packing.


def test_knapsack_and_plan():
    import numpy as np

    value = np.full(11, -np.inf)
    value[[3, 4, 6]] = [3.0, 5.0, 6.5]
    best, first = packing.knapsack(value)
    assert best[10] == 11.5 and sorted(packing._filled(first, 10)) == [4, 6]
    rnd = random.Random(7)
    counts = Counter(rnd.choice([rnd.randint(1, 100), rnd.randint(1, 30)]) for _ in range(3000))
    bins = packing.plan(dict(counts), 100)
    used = Counter()
    for config, times in bins:
        assert times > 0 and sum(config) <= 100
        used.update({n: k * times for n, k in Counter(config).items()})
    assert used == counts
    total = sum(n * k for n, k in counts.items())
    assert sum(t for _, t in bins) <= -(-total // 100) + 2
    assert packing.plan({}, 100) == []
    with pytest.raises(ValueError):
        packing.plan({101: 1}, 100)


def test_the_plan_does_not_grow_with_the_pieces():
    counts = {n: 1000 + n for n in range(1, 65)}
    small, large = packing.plan(counts, 64), packing.plan({n: k * 10_000 for n, k in counts.items()}, 64)
    assert len(large) < 3 * len(small) + 200


def test_pieces_and_sequences(spark):
    texts = [None, "", " ", "One two, three.", "same", "same", "word " * 9000, *strange_texts(60, 8)]
    frame = documents(spark, texts).withColumn("offset", F.lit(9))
    items = packing.pieces(frame, "word_bpe_49k.json")
    rows = [r.asDict() for r in packing.pack(items).collect()]
    library, by = tokenizer("word_bpe_49k.json"), {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(by[i], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), 4096))
        for r in own:
            part = ids[r["start"] : r["start"] + 4096]
            assert r["length"] == len(part)
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) == -(-sum(r["length"] for r in rows) // 4096)
    assert packing.pack(items.limit(0)).count() == 0


# Mixing.


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def test_mix_meets_its_targets(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice(["b", "b", "b", "a", "é", "z", None]), rnd.choice([0, 3, rnd.randint(1, 900)])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, n int").withColumn("target", F.lit("x"))
    got = mixing.copies(frame, F.col("n")).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    targets = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert 0 <= r.copies <= 2 and r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] += r.copies * r.size
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 450  # half of the largest document
    again = {r.doc_id: r.copies for r in mixing.copies(frame.repartition(7), F.col("n")).collect()}
    assert again == {r.doc_id: r.copies for r in got}


def test_mix_in_many_blocks_with_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "FAN", 3)
    rows = [(i // 4, "s" if i % 8 < 4 else None, 10 + i // 4 % 5) for i in range(800)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, n int")
    got = mixing.copies(frame, F.col("n")).collect()
    assert len(got) == 800
    for source in ("s", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 7


def test_duels_keep_expected_copies():
    import numpy as np

    u = (np.arange(2000) + 0.5) / 2000
    ends = [mixing.duel(0.3, 5, 0.6, 11, x) for x in u]
    assert np.mean([e[0] for e in ends]) == pytest.approx(0.3, abs=2e-3)
    assert np.mean([e[1] for e in ends]) == pytest.approx(0.6, abs=2e-3)
    for p, q in ends:
        assert p * 5 + q * 11 == pytest.approx(0.3 * 5 + 0.6 * 11)
        assert p in (0.0, 1.0) or q in (0.0, 1.0)


def test_mix_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id bigint, source string, n int")
    assert mixing.copies(frame, F.col("n")).count() == 0
    empty = spark.createDataFrame([(None, None, 0), (1, "a", 0)], "doc_id bigint, source string, n int")
    assert [r.copies for r in mixing.copies(empty, F.col("n")).collect()] == [0, 0]


# Toxicity.


def brute_segments(scores):
    """Ruzzo and Tompa's definition, by recursion on the best segment."""
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    total, i = best[0], -best[2]
    j = i - best[1]
    right = [(s + j, e + j, x) for s, e, x in brute_segments(scores[j:])]
    return brute_segments(scores[:i]) + [(i, j, total)] + right


def test_segments_equal_their_definition():
    rnd = random.Random(11)
    for _ in range(300):
        n = rnd.randint(0, 14)
        hits = {i: float(rnd.randint(1, 6)) + rnd.random() / 8 for i in range(n) if rnd.random() < 0.4}
        scores = [hits.get(i, -1.0) for i in range(n)]
        got = toxicity.maximal_segments(sorted(hits.items()), n, 1.0)
        want = brute_segments(scores)
        assert [(s, e) for s, e, _ in got] == [(s, e) for s, e, _ in want]
        assert [x for *_, x in got] == pytest.approx([x for *_, x in want])


def test_toxic_words_are_learnt(spark):
    rnd = random.Random(12)
    clean = lambda: " ".join(f"w{''.join(rnd.choice('abcdefg') for _ in range(5))}" for _ in range(80))
    rows = [(i, (clean() + " you horrid scumlike scum " + clean()) if i % 4 == 0 else clean(), int(i % 4 == 0)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = toxicity.fit(frame.unionByName(spark.createDataFrame([(900, None, 0), (901, "x", None)], frame.schema)))
    texts = documents(spark, [None, "", "such horrid scumlike scum", LONG, LONG + " you horrid scumlike scum"]).withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in toxicity.score(texts, model).collect()}
    assert [got[i].score >= 0.5 for i in range(5)] == [False, False, True, False, True]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert len(got[4].passages) == 1 and got[4].passages[0].end == got[4].n_tokens
    nothing = toxicity.fit(frame.limit(0))
    assert [r.score < 0.5 for r in toxicity.score(texts, nothing).collect()] == [True] * 5
    wordless = spark.createDataFrame([(1, None, 1), (2, "", 0), (3, "1 2", 1)], frame.schema)
    assert toxicity.fit(wordless).odds == {}


def test_held_out_accuracy_on_the_given_labels(spark):
    from tracewise.llm.queries import op9_toxicity

    folder = "/root/testdata/sf0.01"
    got = op9_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = got.filter("held_out AND toxic IS NOT NULL").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.93


def test_quality_sql(spark):
    from tracewise.llm.sql import ORACLES
    from tracewise.llm.queries import op3_quality_rules

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = db.execute(ORACLES["op3_quality_rules"]).fetchall()
    assert sorted(map(tuple, op3_quality_rules(spark, SF).collect())) == sorted(want)

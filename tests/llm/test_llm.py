import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexmill.llm.audio import align_recordings, fingerprint_audio
from lexmill.llm.bpe_codec import decode_bpe, encode_bpe, encode_text, encoding
from lexmill.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from lexmill.llm.ngram_join import keep_one_per_component, near_duplicate_components
from lexmill.llm.packing import pack_documents, plan_packing
from lexmill.llm.pii import find_pii, redact
from lexmill.llm.repeats import remove_repeats
from lexmill.llm.sharding import shard_by_bytes
from lexmill.llm.token_prefix import PrefixCounter, count_prefixes, longest_within, tokens_of_prefix
from lexmill.llm.toxicity import TermMachine, ToxicityModel, fit_toxicity, keep_clean, score_toxicity

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BITS = ["a", "b", "'s", "'", "re", " ", "  ", "\n", "1", "!", "é", "日本", "<|endoftext|>", "<|", "\x85", "the", "ing"]
SCHEMA = "doc_id long, text string, digest string"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)


def _texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    out += [None, "", " \t", out[0], out[0], out[1] + " end", "same " * 40]
    return out + [" ".join(w for w in (out[k % n] or "").split() if rng.random() > 0.02) for k in range(n)]


def test_exact_dedup_against_brute_force(spark):
    texts = [*_texts(1, 12), "a b", "ab", " a b "]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i))
    found = exact_duplicates(_docs(spark, texts).repartition(5), fan_in=2).collect()
    for row in found:
        norm = re.sub("[\x20\x09-\x0d]", "", texts[row.doc_id] or "")
        assert (row.keep_id, row.group_size, row.text_sha256) == (min(groups[norm])[1], len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest())
        assert row.kept == (row.doc_id == row.keep_id)
    assert len(found) == len(texts)
    twice = _docs(spark, ["t"]).union(_docs(spark, ["t"]))
    assert drop_exact_duplicates(twice).count() == 1
    assert exact_duplicates(_docs(spark, ["t"]).limit(0)).count() == 0


def test_sharding_law_and_slots(spark):
    texts = ["hot" * 9] * 300 + [f"text {i}" * (i % 7) for i in range(600)]
    docs = spark.createDataFrame([(i, len(t) + 8, t) for i, t in enumerate(texts)], "doc_id long, size long, grp string")
    rows = shard_by_bytes(docs, "size", "grp", "doc_id", shards=6, tolerance=0.01).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(sizes.values()) / 6
    assert len(rows) == 900 and all(abs(s - mean) < 0.03 * mean + 100 for s in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_by_bytes(docs.limit(0), "size", "grp", "doc_id", shards=6).count() == 0


def test_every_prefix_count(spark):
    rng, table, library = random.Random(3), PrefixCounter(JSON), Tokenizer.from_file(JSON)
    for _ in range(200):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 9)))
        counts = table.counts(text)
        assert [len(library.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)] == counts.tolist()
        assert table.summary(text, (2,)) == (counts[-1], int(np.flatnonzero(counts <= 2)[-1]))


def test_codec_round_trip_and_safe_cuts(spark):
    codec, rng = encoding(RANKS, public_tokenizers.PATTERN), random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(BITS) for _ in range(60))
        assert encode_text(codec, text, 7).tolist() == codec.encode_ordinary(text)
    docs = _docs(spark, ["", None, "héllo  wörld", "a" * 70_000])
    coded = encode_bpe(docs, RANKS, public_tokenizers.PATTERN)
    plain = {r.doc_id: bytes(r.decoded).decode() for r in decode_bpe(coded, RANKS, public_tokenizers.PATTERN).collect()}
    assert plain == {0: "", 1: "", 2: "héllo  wörld", 3: "a" * 70_000}


def test_pii_against_brute_force(spark):
    texts = [None, "", "é x@y.zz_d@e.ff 1.2.3.4.5.6.7.8 999.1.1.1", "4111 1111-1111 1111 and +1 (487) 555-7209, GB82 WEST 1234 5698 7654 32", "7" * 30_000]
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii_spans] for r in find_pii(_docs(spark, texts)).collect()}
    assert spans[0] == spans[1] == spans[4] == []
    email = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", texts[2])]
    ip = [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", texts[2]) if all(int(x) <= 255 for x in m[0].split("."))]
    assert len(email) == len(ip) == 2 and spans[2] == email + ip
    assert spans[3] == [("card", 0, 19), ("phone", 24, 41), ("iban", 43, 70)]
    out = {r.doc_id: r.text for r in redact(_docs(spark, texts)).collect()}
    assert out[0] is None and out[3] == "[card] and [phone], [iban]"


def _components(texts):
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_duplicates_against_brute_force(spark):
    texts = _texts(5, 25)
    component, size = _components(texts)
    rows = near_duplicate_components(_docs(spark, texts)).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in rows} == {i: (c, n) for i, (c, n) in enumerate(zip(component, size))}


def test_near_duplicates_in_long_lists_against_brute_force(spark):
    """Groups of more than eight edited copies about the threshold, and passages that unlike texts share."""
    draw = random.Random(11)
    words = lambda n: [f"w{draw.randrange(4000)}" for _ in range(n)]
    passage, texts = words(14), []
    for size, length in ((24, 90), (14, 40), (9, 160), (6, 60)):
        base = words(length)
        for _ in range(size):
            copy = list(base)
            for _ in range(draw.randrange(0, 1 + length // 22)):
                copy[draw.randrange(len(copy))] = f"new{draw.randrange(10**6)}"
            texts.append(" ".join(copy[draw.randrange(3) : len(copy) - draw.randrange(3)]))
    texts += [" ".join(words(draw.randrange(2, 25)) + passage + words(draw.randrange(2, 25))) for _ in range(30)]
    draw.shuffle(texts)
    component, size = _components(texts)
    assert len(set(component)) < len(texts) - 20
    rows = near_duplicate_components(_docs(spark, texts)).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in rows} == {i: (c, n) for i, (c, n) in enumerate(zip(component, size))}


def test_repeats_against_brute_force(spark):
    texts = _texts(6, 25)
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    for r in remove_repeats(_docs(spark, texts)).collect():
        w = words[r.doc_id]
        gone = {k for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < r.doc_id for k in range(p, p + 13)}
        assert (r.n_words, r.n_removed, r.kept) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))


@pytest.mark.parametrize("seed", range(5))
def test_packing_plan_places_everything(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randint(1, 100) for _ in range(300))
    plan = plan_packing(counts, 100)
    placed = Counter()
    for times, content in plan:
        assert sum(length * n for length, n in content) <= 100
        for length, n in content:
            placed[length] += n * times
    assert placed == counts
    # The bound of Martello and Toth: pieces over half need a sequence each, and what is left beside them is filled first.
    bound = 0
    for k in range(1, 51):
        alone = sum(v for x, v in counts.items() if x > 100 - k)
        half = {x: v for x, v in counts.items() if 50 < x <= 100 - k}
        room = 100 * sum(half.values()) - sum(x * v for x, v in half.items())
        small = sum(x * v for x, v in counts.items() if k <= x <= 50)
        bound = max(bound, alone + sum(half.values()) + max(0, -(-(small - room) // 100)))
    assert sum(t for t, _ in plan) <= 1.02 * bound + 1


def test_packing_is_gapless(spark):
    rows = pack_documents(_docs(spark, ["a b c " * k for k in range(30)] + [None]), JSON, capacity=16).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 16


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_term_machine_against_distances():
    rng, terms = random.Random(7), ["scum", "idiot", "worthless", "stupid"]
    machine, allowed = TermMachine(terms), {"scum": 0, "idiot": 1, "worthless": 2, "stupid": 1}
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            word[rng.randrange(len(word))] = rng.choice(["", "x", "o", "ss"])
        word = "".join(word) or "x"
        near = [(_distance(word, t), k) for k, t in enumerate(terms) if _distance(word, t) <= allowed[t]]
        assert machine.match(word) == (min(near) if near else None)


def test_toxicity_learns_and_survives_empty_tables(spark):
    texts = [f"plain words number {i} here" for i in range(60)] + [f"you stupid idiot number {i}" for i in range(30)] + [None, "you stupyd idiott"]
    docs = _docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(90)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    model = fit_toxicity(docs, labels, F.lit(True))
    scores = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    assert all((scores[i] >= 0.5) == (i >= 60) for i in range(90)) and scores[90] < 0.5
    empty = fit_toxicity(docs, labels.limit(0), F.lit(True))
    assert all(r.predicted == 0 for r in score_toxicity(docs, empty).collect())


def test_toxicity_learns_rare_terms_and_stems(spark):
    """Most toxic texts have one of twenty insults each, or one of a family of forms seen once each."""
    from pyspark.sql import functions as F

    draw = random.Random(12)
    filler = lambda n: " ".join(f"{draw.choice('bcdfgh')}{draw.randrange(300)}xyz" for _ in range(n))
    insults = ["".join(draw.choice("jkqvz") for _ in range(7)) for _ in range(20)]
    family = ["grumpel" + a + b for a in "abcdefghij" for b in "klmnopqrst"]
    toxic = [(f"{filler(12)} stupid", "common") for _ in range(60)]
    toxic += [(f"{filler(12)} {x}", "rare") for x in insults for _ in range(11)] + [(f"{filler(12)} {x}", "family") for x in family]
    toxic = [(i, *x, 1) for i, x in enumerate(toxic)]
    clean = [(len(toxic) + i, filler(13), "clean", 0) for i in range(3000)]
    rows = spark.createDataFrame(toxic + clean, "doc_id long, text string, kind string, toxic int")
    held = F.col("doc_id") % 5 == 0
    model = fit_toxicity(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), ~held)
    assert "grumpel*" in model.terms and set(insults) <= set(model.terms)
    found = score_toxicity(rows.filter(held).select("doc_id", "text"), model).join(rows, "doc_id").groupBy("kind").agg(F.avg("predicted").alias("share")).collect()
    share = {r.kind: r.share for r in found}
    assert min(share["common"], share["rare"], share["family"]) > 0.9 and share["clean"] < 0.02


def test_term_machine_matches_stems():
    machine = TermMachine(["grumpel*", "worthless"])
    assert [machine.match(w) for w in ("grumpel", "grumpelfoo", "grumpe", "grumpfel", "worthles", "worth")] == [(0, 0), (0, 0), None, None, (1, 1), None]


def test_recordings_match_their_copies_however_short_or_steady(spark):
    noise = lambda seed, n: np.random.default_rng(seed).integers(0, 256, n).astype(np.uint8).tobytes()
    one = noise(1, 1216)  # one print
    tone = bytes(128 + int(100 * np.sin(i * np.pi / 4)) for i in range(4096))  # its period divides the hop: one integer
    audio = [b"short", one, tone, noise(2, 6000), b"short", one, tone, b"", None, b"", noise(3, 640) + one + noise(4, 100), noise(2, 6000)[640:4000], b"other", tone[:3000]]
    audio += [one + b"\x80" * 63]  # too short for another print, no exact copy
    docs = spark.createDataFrame([(i, None if a is None else bytearray(a)) for i, a in enumerate(audio)], "doc_id long, audio binary")
    rows = {r.doc_id: r for r in align_recordings(fingerprint_audio(docs, "doc_id", "audio"), "doc_id").collect()}
    assert len(rows) == len(audio)
    found = {i: (r.match_id, r.offset, r.bit_error_rate) for i, r in rows.items() if r.match_id is not None}
    assert found == {4: (0, 0, 0.0), 5: (1, 0, 0.0), 6: (2, 0, 0.0), 11: (3, -10, 0.0), 13: (2, 0, 0.0), 14: (1, 0, 0.0)}
    assert (rows[4].votes, rows[5].votes, rows[6].votes) == (0, 1, rows[6].n_prints)


def test_near_duplicates_split_large_groups(spark, monkeypatch):
    """With groups of three at most in one task, lists are split by differences."""
    monkeypatch.setattr("lexmill.llm.ngram_join._GROUP", 3)
    test_near_duplicates_in_long_lists_against_brute_force(spark)


ODD = "doc_id long, text string, node string, _nj_node2 long, pii_spans string, n_chars long"


def _odd_docs(spark):
    """Null ids and texts, repeated ids and rows, blank texts, and columns named like the operators' own."""
    same, other = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(None, same), (1, same), (1, same), (2, same), (3, other), (3, "quite another text under this same id"), (4, None), (5, ""), (6, " "), (None, None)]
    return spark.createDataFrame([(i, t, "n", 7, "p", 0) for i, t in rows], ODD)


def test_one_row_of_each_component_stays(spark):
    docs = _odd_docs(spark)
    kept = keep_one_per_component(docs)
    assert kept.columns == docs.columns
    found = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.node, r._nj_node2) for r in kept.collect())
    texts = [(False, 1, "one two three four five six"), (False, 3, "quite another text under this same id"), (False, 3, "seven eight nine ten eleven twelve")]
    blank = [(False, 4, ""), (False, 5, ""), (False, 6, " "), (True, 0, "")]
    assert found == sorted((*r, "n", 7) for r in texts + blank)
    assert keep_one_per_component(docs.limit(0)).count() == 0


def test_stages_keep_columns_and_survive_odd_rows(spark):
    docs = _odd_docs(spark)
    model = ToxicityModel(["seven"], [1.0], np.array([9.0, 0, 0, 0, 0, 0]), -3.0)
    clean = keep_clean(docs, model)
    assert clean.columns == docs.columns and sorted(str(r.text) for r in clean.collect()) == sorted(str(r.text) for r in docs.collect() if "seven" not in (r.text or ""))
    once = drop_exact_duplicates(docs)
    assert once.columns == docs.columns and Counter((r.doc_id, r.text) for r in once.collect())[(1, "one two three four five six")] == 1 and once.count() == 4
    marked = redact(docs.withColumn("text", docs.node), "text")
    assert marked.columns == docs.columns and {r.pii_spans for r in marked.collect()} == {"p"}
    packed = pack_documents(docs, JSON, capacity=2048, end_id=0).collect()
    assert sum(r.length for r in packed) == sum(len(Tokenizer.from_file(JSON).encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    for stage in (lambda d: keep_clean(d, model), drop_exact_duplicates, redact):
        assert stage(docs.limit(0)).count() == 0


def test_token_counts_against_the_library(spark):
    texts = [*_texts(3, 6), "It's  naïve\n\n日本 <|endoftext|> x", None, ""]
    library = Tokenizer.from_file(JSON)
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    rows = count_prefixes(_docs(spark, texts), JSON, budgets=(4,), keep_prefixes=True)
    rows = rows.select("*", longest_within(rows.prefix_tokens, 4).alias("within"), tokens_of_prefix(rows.prefix_tokens, 3).alias("three")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_chars, r.n_tokens) == (len(text.encode()), len(text), len(ids[r.doc_id]))
        assert r.prefix_tokens[-1] == r.n_tokens and r.within == r.fits_4
        assert r.three == len(library.encode(text[:3], add_special_tokens=False).ids)
        assert r.fits_4 == max(n for n in range(len(text) + 1) if len(library.encode(text[:n], add_special_tokens=False).ids) <= 4)


def test_pii_of_a_long_text_with_many_matches(spark):
    text = "write to some.one@mail.example.org or 10.1.2.3 and more " * 700
    row = redact(find_pii(_docs(spark, [text]))).first()
    assert [(s.kind, s.start) for s in row.pii_spans[:2]] == [("email", 9), ("email", 65)] and len(row.pii_spans) == 1400
    assert row.text == "write to [email] or [ip] and more " * 700

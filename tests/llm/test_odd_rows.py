"""Every operator on null ids, null, blank and very long texts, repeated rows, empty tables and clashing columns; results by brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm.audio import _agree, _Recordings, align_recordings, fingerprint_audio
from lexmill.llm.bpe_codec import encode_bpe, encoding
from lexmill.llm.bpe_text import load_ranks
from lexmill.llm.exact_dedup import exact_duplicates
from lexmill.llm.ngram_join import near_duplicate_components
from lexmill.llm.packing import pack_documents
from lexmill.llm.pii import BASE_KINDS, find_pii
from lexmill.llm.repeats import remove_repeats
from lexmill.llm.sharding import shard_by_bytes
from lexmill.llm.token_prefix import count_prefixes

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, words int, keep_id string, shard int, part string"


def _rows(seed=1):
    rng = random.Random(seed)
    words = ["the", "ing", "über", "日本", "x", "don't", "1234", "a\x0bb", "naïve", "é"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    texts = [text(rng.randint(0, 40)) for _ in range(30)]
    texts += [None, "", " \t\n", texts[0], texts[0], "\n " * 3000, "word " * 20_000, "x" * 100_000, text(8) + " " + texts[3], texts[3] + " tail", "a " * 13, "<|endoftext|> and text"]
    ids = [None if i in (4, 33) else i // 2 if i > 36 else i for i in range(len(texts))]
    return list(zip(ids, texts)) + [(3, texts[3])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7, "x", 9, "y") for i, t in _rows()], SCHEMA).repartition(3)


def test_empty_tables_give_empty_results(spark, docs):
    none = docs.limit(0)
    assert count_prefixes(none, JSON).count() == near_duplicate_components(none).count() == remove_repeats(none).count() == pack_documents(none, JSON).count() == find_pii(none).count() == exact_duplicates(none).count() == 0
    assert encode_bpe(none, RANKS, public_tokenizers.PATTERN, decode=True).count() == 0
    assert align_recordings(fingerprint_audio(none.select("doc_id", F.col("text").cast("binary").alias("audio")), "doc_id", "audio"), "doc_id").count() == 0


def test_token_counts(docs):
    library = Tokenizer.from_file(JSON)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in _rows())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in count_prefixes(docs, JSON).collect()) == want


def test_codec_with_any_pattern(spark, docs):
    for pattern in (public_tokenizers.PATTERN, r"\S+|\s+"):  # the second is not the split that long texts are cut by
        codec = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(RANKS), special_tokens={})
        some = docs.filter("text is null or length(text) < 90000")
        want = Counter((i, tuple(codec.encode_ordinary(t or ""))) for i, t in _rows() if len(t or "") < 90_000)
        found = encode_bpe(some, RANKS, pattern, chunk_chars=2_000, decode=True).collect()
        assert Counter((r.doc_id, tuple(int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4))) for r in found) == want
        assert Counter((r.doc_id, bytes(r.decoded)) for r in found) == Counter((i, (t or "").encode()) for i, t in _rows() if len(t or "") < 90_000)
    assert encoding(RANKS, public_tokenizers.PATTERN).n_vocab > 50_000


def test_packing(docs):
    library, capacity = Tokenizer.from_file(JSON), 64
    small = docs.filter("text is null or length(text) < 90000")
    found = pack_documents(small, JSON, capacity=capacity, end_id=0, keep_ids=True).collect()
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in _rows() if len(t or "") < 90_000)
    numbers = lambda raw: [int.from_bytes(raw[k : k + 4], "little") for k in range(0, len(raw), 4)]
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and (r.length == capacity or r.piece == 0) for r in found)
    # The pieces of a document that stands alone under its id are its ids.
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append(r)
    alone = {i: ids for (i, ids), n in want.items() if n == 1 and sum(k == i for k, _ in want) == 1}
    for i, ids in alone.items():
        parts = sorted(by_id[i], key=lambda r: r.piece)
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))] and [x for r in parts for x in numbers(r.ids)] == list(ids)
    assert sum(r.length for r in found) == sum(len(ids) * n for (_, ids), n in want.items())
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= capacity


def _words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def test_near_duplicates(docs):
    fold = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in _words(t)]
    rows = [(i, fold(t)) for i, t in _rows()]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for _, w in rows]
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                part = [part[b] if p == part[a] else p for p in part]
    least = {p: min((rows[k][0] for k in range(len(rows)) if part[k] == p and rows[k][0] is not None), default=None) for p in part}
    want = Counter((rows[k][0], len(sets[k]), least[part[k]]) for k in range(len(rows)))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicate_components(docs).collect()) == want


def test_repeats(docs):
    rows = [(i if i is not None else 1 << 70, _words(t)) for i, t in _rows()]
    first = {}
    for i, w in rows:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(i, first.get(key, i))
    want = Counter()
    for (_, w), (i, _), (shown, _) in zip(rows, rows, _rows()):
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want[shown, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(docs, window=13).collect()) == want


def test_shards_by_counting(docs):
    sized = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"), F.coalesce("text", F.lit("")).alias("grp"), "keep_id", "words")
    found = shard_by_bytes(sized, "size", "grp", "doc_id", shards=3).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, len((t or "").encode()) + 8) for i, t in _rows())
    slots, sizes = defaultdict(list), Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= {0, 1, 2}
    assert max(sizes.values()) <= sum(sizes.values()) / 3 + max(r.size for r in found)


def _luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


#: The base kinds of the contract: pattern, and what confirms a match.
BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and _luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def test_personal_data_by_regular_expressions(spark):
    rng = random.Random(11)
    bits = ["+49 ", "(030) ", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "a@b.de", "@x.", "1.2.3.4", "300.1.1.1", "7", "12", " ", "-", ".", "+", "é", "日本 ", "x_y%", "\n", "+1 (555) 010-9999", "0" * 5]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(600)] + [None, "", "1 " * 2000, "+1" * 500, "4111 1111 1111 1111 " * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii_spans if s.kind in BASE_KINDS] for r in find_pii(df).collect()}
    for i, text in enumerate(texts):
        want = [(kind, m.start(), m.end()) for kind, (pattern, good) in BASE.items() for m in re.finditer(pattern, text or "") if good(m[0])]
        assert found[i] == want, text


def test_recordings_with_null_and_repeated_ids(spark, docs):
    prints = fingerprint_audio(docs.filter("text is null or length(text) < 90000").select("doc_id", F.col("text").cast("binary").alias("audio"), "words"), "doc_id", "audio")
    found = align_recordings(prints, "doc_id").collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, t in _rows() if len(t or "") < 90_000)
    assert all(r.match_id is None for r in found if r.doc_id is None) and all(r.match_id < r.doc_id for r in found if r.match_id is not None)


def _linked_recordings() -> list[tuple[int | None, list[int], bytes | None]]:
    """(id, prints, samples' digest): scattered and repeated passages, copies, near copies, steady and short ones."""
    rng = random.Random(6)
    noise = lambda n, k=60: [rng.randrange(k) for _ in range(n)]
    first, second, loop = [1000 + i for i in range(40)], [2000 + i for i in range(40)], [3000 + i for i in range(12)]
    prints = [first, second, first[5:30] + second[8:20], loop * 5, [4000, *loop[4:12], 4001], loop[3:] + first[30:]]
    prints += [noise(rng.choice([1, 2, 3, 4, 6, 20, 60])) for _ in range(60)] + [noise(rng.randint(1, 30), 2) for _ in range(20)]
    prints += [[7] * n for n in (1, 3, 9, 300, 301)] + [[7] * 200 + first[:5] + [7] * 90, [7] * 150 + first[:5], [7] * 50 + [8] * 50 + [9] * 50 + [5] * 50, [8] * 60 + [9] * 50 + [5] * 70 + [7] * 9]
    near = noise(50)
    for _ in range(12):
        prints.append([p if rng.random() > 0.3 else rng.randrange(60) for p in near])
    rows = [(3 * i + 1, p, f"d{i}".encode()) for i, p in enumerate(prints)]
    rows += [(i - 1, p, d) for i, p, d in rng.sample(rows, 8)]  # exact copies
    rows += [(i + 1, p, d + b"+") for i, p, d in rng.sample(rows[: len(prints)], 12)]  # equal prints of other samples
    rows += [(None, first, b"d0"), (5000, [], None), (5001, [], b"s"), (5002, [], b"s")]
    rng.shuffle(rows)
    return rows


def _aligned_by_brute_force(rows: list) -> dict:
    """Per id: match_id, offset, votes, bit_error_rate, class_id, n_links."""
    classes = {}
    for i, p, d in rows:
        if i is not None and d is not None:
            classes[d] = (min(i, classes.get(d, (i,))[0]), p)
    best, links = {}, Counter()
    for (x, a), (y, b) in combinations(sorted((c for c in classes.values() if c[1]), reverse=True), 2):
        few = len(set(a)) < 4, len(set(b)) < 4
        for offset in sorted(range(1 - len(b), len(a)), key=lambda o: (abs(o), o)):
            over = list(zip(a[max(0, offset) :], b[max(0, -offset) :]))
            same = [u for u, v in over if u == v]
            if len(same) == min(len(a), len(b)) if any(few) else len(set(same)) >= 4:
                rate = sum((u ^ v).bit_count() for u, v in over) / (32 * len(over))
                if (x, y) not in best or len(same) > best[x, y][0]:
                    best[x, y] = len(same), offset, rate, few[0] or not few[1]
        for side in (x, y):
            links[side] += (x, y) in best
    out = {}
    for i, p, d in rows:
        name = classes[d][0] if i is not None and d is not None else i
        found = [(-votes, y, offset, rate) for (x, y), (votes, offset, rate, fits) in best.items() if x == i and fits]
        if name != i:
            found = [(-len(p), name, 0, 0.0)]
        votes, match, offset, rate = min(found, default=(None,) * 4)
        out[i] = (match, offset, None if votes is None else -votes, rate, name, None if i is None else links[name])
    return out


@pytest.mark.parametrize("blocks", [1, 3])
def test_all_links_of_recordings_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr("lexmill.llm.audio._SMALL_BLOCK", 100)
    monkeypatch.setattr("lexmill.llm.audio._FEW_BLOCKS", blocks)
    rows = _linked_recordings()
    df = spark.createDataFrame([(i, len(p), p, None if d is None else bytearray(d)) for i, p, d in rows], "doc_id long, n_frames long, prints array<int>, digest binary")
    found = {r.doc_id: (r.match_id, r.offset, r.votes, r.bit_error_rate, r.class_id, r.n_links) for r in align_recordings(df, "doc_id").collect()}
    want = _aligned_by_brute_force(rows)
    assert found == want
    assert sum(w[0] is not None for w in want.values()) > 40 and sum((w[5] or 0) > 1 for w in want.values()) > 40


@pytest.mark.parametrize(("votes", "many"), [(1 << 18, 1 << 22), (64, 1 << 22), (64, 2000), (64, 100)])
def test_offsets_of_recordings_however_they_are_counted(monkeypatch, votes, many):
    monkeypatch.setattr("lexmill.llm.audio._VOTES", votes)
    monkeypatch.setattr("lexmill.llm.audio._MANY", many)
    prints = [p for _, p, d in _linked_recordings() if p]
    both = _Recordings.of(np.concatenate(prints).astype(np.uint32), np.array([len(p) for p in prints]))
    found = [row for part in _agree(both, both, 4) for row in zip(*(x.tolist() for x in part))]
    want = {}
    for (i, a), (j, b) in product(enumerate(prints), repeat=2):
        for offset in {x - y for x, y in product(range(len(a)), range(len(b))) if a[x] == b[y]}:
            same = [u for u, v in zip(a[max(0, offset) :], b[max(0, -offset) :]) if u == v]
            if len(same) >= 4:
                want[i, j, offset] = len(same), len(set(same))
    assert len(found) == len(want) and {row[:3]: row[3:] for row in found} == want

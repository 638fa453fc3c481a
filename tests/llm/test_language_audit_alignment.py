import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm.bpe_text import byte_letters
from lexmill.llm.filter_audit import audit_filters, common_size, difference, judge_documents, reach, union_size
from lexmill.llm.language_id import CrossParser, LanguageModel, SuffixAutomaton, fit_languages, identify_languages, letter_streams
from lexmill.llm.token_alignment import TokenAligner, align_tokens, count_pairs, gallop, overlaps, score_links
from lexmill.llm.token_prefix import PrefixCounter

JSON, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, part string, row_id long, words int"


def _docs(spark, rows):
    """Documents with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, lang, "x", 7, 3) for i, t, lang in rows], SCHEMA)


# Language identification


def _phrases(text: bytes, trained: bytes) -> int:
    """Longest matches from the left, by search in the training text."""
    n = at = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in trained:
            end += 1
        at, n = max(at + 1, end - 1), n + 1
    return n


def test_cross_parsing_against_substring_search():
    rng = random.Random(5)
    for _ in range(60):
        trained = bytes(rng.choice(b"abc ") for _ in range(rng.randint(1, 80)))
        texts = [bytes(rng.choice(b"abcd ") for _ in range(rng.randint(1, 50))) for _ in range(20)]
        texts.sort(key=len, reverse=True)
        starts = np.cumsum([0, *map(len, texts[:-1])])
        found = SuffixAutomaton(trained).phrases(np.frombuffer(b"".join(texts), np.uint8), starts, np.asarray(list(map(len, texts))))
        assert found.tolist() == [_phrases(t, trained) for t in texts]


def test_letter_streams():
    texts = ["Ab, c!", "", "  1 ", "É日x", "İ", "\n z"]
    stream, ends = letter_streams(texts)
    parts = np.split(stream, ends[:-1])
    assert [bytes(p).decode().strip() for p in parts] == ["ab c", "", "", "é日x", "i", "z"]


def test_language_id_on_odd_rows(spark):
    words = {"aa": ["ung", "der", "schen"], "bb": ["tion", "les", "aux"], "日": ["日本", "語文", "字日"]}
    rng = random.Random(1)
    text = lambda lang, n: " ".join("".join(rng.choices(words[lang], k=2)) for _ in range(n))
    rows = [(i, text(lang, 30), lang) for i in range(60) for lang in [list(words)[i % 3]]]
    odd = [(None, text("aa", 20), None), (900, None, "aa"), (901, "", "bb"), (902, "12 !?", None), (903, text("bb", 4000), None), (903, text("日", 5), "aa")]
    docs = _docs(spark, rows + odd + rows[:2])
    train = F.col("doc_id") < 60
    model = fit_languages(docs, train, passages=16, passage_chars=64)
    assert [name for name, _ in model.samples] == ["aa", "bb", "日"]
    assert model == fit_languages(docs.repartition(7), train, passages=16, passage_chars=64)  # whatever the partitions
    found = identify_languages(docs, model).collect()
    assert len(found) == len(rows) + len(odd) + 2 and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r.lang_pred for r in found}
    assert all(by_id[i] == lang for i, _, lang in rows)
    assert (by_id[None], by_id[900], by_id[901], by_id[902]) == ("aa", "und", "und", "und")
    assert sorted(r.lang_pred for r in found if r.doc_id == 903) == ["bb", "日"]
    assert identify_languages(docs.limit(0), model).count() == 0
    nothing = fit_languages(docs.limit(0), train)
    assert nothing == LanguageModel(()) and {r.lang_pred for r in identify_languages(docs, nothing).collect()} == {"und"}


def test_blocks_do_not_change_the_winner():
    parser = CrossParser(LanguageModel((("a", "abcab cabba"), ("x", "xyzxy zxyyz"))))
    names, scores = parser.identify(["abc " * 3000, "xyz " * 3000 + "abc", "ax"])
    assert names == ["a", "x", "a"] and scores[2] <= 0.5 < scores[0]


# Audit of filters


def test_galloping_lists_against_sets():
    rng = random.Random(2)
    for _ in range(300):
        lists = [sorted(rng.sample(range(200), rng.randint(0, 120))) for _ in range(4)]
        sets = list(map(set, lists))
        assert difference(lists[0], lists[1:]) == sorted(sets[0] - sets[1] - sets[2] - sets[3])
        assert union_size(lists) == len(set.union(*sets)) and common_size(lists[0], lists[1]) == len(sets[0] & sets[1])
        value, at = rng.randint(0, 201), rng.randint(0, 120)
        assert reach(lists[0], value, min(at, len(lists[0]))) == next((k for k in range(min(at, len(lists[0])), len(lists[0])) if lists[0][k] >= value), len(lists[0]))


def _audit(rows):
    """Counts by walking every order over every document."""
    out = {}
    for part in {p for p, *_ in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                failed = [r for r in own if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(removed)
                out[part, order, step] = [len(left), len(removed), len(failed) - len(removed), sum(r[1] == f for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def test_audit_against_every_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["en", "de", ""]), "".join(f for f in "ABCDE" if rng.random() < 0.3), rng.random() < 0.4, rng.random() < 0.1) for _ in range(400)] + [("clean", "", True, False)]
    table = spark.createDataFrame([(i * 97, p or None, *(f in fails for f in "ABCDE"), g, x) for i, (p, fails, g, x) in enumerate(rows)], "row_id long, part string, A boolean, B boolean, C boolean, D boolean, E boolean, good boolean, toxic boolean")
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit_filters(table, "ABCDE").collect()}
    assert found == _audit(rows)
    assert audit_filters(table.limit(0), "ABCDE").count() == 0


def test_judging_odd_documents(spark):
    long = " ".join(f"w{i}" for i in range(100))
    texts = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (None, long, None), (3, None, "de"), (4, "", "de"), (5, "A" * 9 + "b" * 81, "de"), (6, "A" * 10 + "b" * 90, "de"), (7, "same " * 100, "en"), (8, long + " |", "en"), (9, "x " * 200_000, "en")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = judge_documents(_docs(spark, texts), labels).collect()
    fails = sorted(((r.part or "", "".join(f for f in "ABCDE" if r[f]), r.good, r.toxic) for r in found))
    assert fails == sorted([("en", "", True, False), ("en", "E", True, True), ("en", "E", True, True), ("", "", False, False), ("de", "A", False, False), ("de", "AE", False, False), ("de", "A", False, False), ("de", "A", False, False), ("en", "B", False, False), ("en", "D", False, False), ("en", "B", False, False)])
    assert len({r.row_id for r in found}) == len(texts)
    assert judge_documents(_docs(spark, []), labels.limit(0)).count() == 0


# Alignment of tokens


def test_gallop_and_overlaps():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.choice([5, 200, 2000])
        lists = sorted((sorted(rng.sample(range(3 * n), rng.randint(1, n))) + [3 * n] for _ in range(2)), key=len)
        short, long = map(np.asarray, lists)
        assert gallop(short, long).tolist() == np.searchsorted(long, short).tolist()
    for _ in range(100):
        left, right = (sorted(rng.sample(range(1, 40), rng.randint(0, 20))) + [40] for _ in range(2))
        spans = lambda ends: list(zip([0, *ends[:-1]], ends))
        expected = [[j for j, (c, d) in enumerate(spans(right)) if c < b and a < d] for a, b in spans(left)]
        assert [list(range(*o)) for o in overlaps(left, right)] == expected


def _aligned(text, library, aligner):
    """Ids and groups by the libraries and sets of ends."""
    if not text:
        return [], [], []
    letters, a, b = byte_letters(), library.encode(" " + text, add_special_tokens=False).ids, aligner.pieces.encode(text)
    left = [bytes(letters[c] for c in library.id_to_token(i)) for i in a]
    right = [aligner.bytes_b[i] for i in b]
    if not b"".join(left) == b"".join(right) == (" " + text).encode():
        return [], [], []
    ends = [[sum(map(len, side[: k + 1])) for k in range(len(side))] for side in (left, right)]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        groups.append((a[i : ends[0].index(end) + 1], b[j : ends[1].index(end) + 1]))
        i, j = ends[0].index(end) + 1, ends[1].index(end) + 1
    return a, b, groups


def test_alignment_against_the_libraries(spark):
    rng = random.Random(6)
    bits = ["a", "b", "'s", "re", " ", "  ", "\n", "1", "!", "é", "日本", "<|endoftext|>", "<s>", "</s>", "<0x41>", "\x85", "the", "ing", " the", "▁", "\xa0", "\t", "\x00", "ﬁ", "　"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(400)] + [None, "", " ", " x ", "word " * 30_000, "x" * 30_000, "\n \t" * 5_000]
    docs = _docs(spark, [(None if i % 50 == 9 else i // 2, t, "en") for i, t in enumerate(texts)])
    library, aligner = Tokenizer.from_file(JSON), TokenAligner(JSON, PIECES)
    library.encode_special_tokens = True
    expected, linked, most = [], Counter(), Counter()
    for text in texts[:-3]:
        expected.append(_aligned(text, library, aligner))
        linked.update((x[-1], y[-1]) for x, y in expected[-1][2])
    aligned = align_tokens(docs.repartition(3), JSON, PIECES).cache()
    for (_, y), n in linked.items():
        most[y] = max(most[y], n)
    short = aligned.filter(F.col("n_a") < 1000).cache()
    written = Counter((r.n_a, r.n_b, r.n_groups, r.groups) for r in short.collect())
    own = [(len(a), len(b), len(g), ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)) for a, b, g in expected]
    assert written == Counter(own)
    pairs = count_pairs(short, aligner.size_b)
    assert {(r.pair // aligner.size_b, r.pair % aligner.size_b): (r.n, r.best) for r in pairs.collect()} == {p: (n, n == most[p[1]]) for p, n in linked.items()}
    scores = Counter((sum(linked[x[-1], y[-1]] == most[y[-1]] for x, y in g), sum(linked[x[-1], y[-1]] for x, y in g)) for _, _, g in expected)
    for room in (1 << 21, 5, 0):  # all pairs sent, some, none: the same result
        found = score_links(short, pairs, broadcast_pairs=room).collect()
        assert Counter((r.n_best, r.count_sum) for r in found) == scores
    long = aligned.filter(F.col("n_a") >= 1000).collect()
    assert sorted(r.n_a for r in long) == sorted(len(library.encode(" " + t, add_special_tokens=False).ids) for t in texts[-3:])
    empty = align_tokens(docs.limit(0), JSON, PIECES)
    assert score_links(empty, count_pairs(empty, aligner.size_b)).count() == 0


def test_queries_have_the_contracts_columns(spark):
    from lexmill.llm.queries import QUERIES

    rows = {n: QUERIES[n](spark, "/root/testdata/sf0.001") for n in ("op11_language_id", "op12_filter_audit", "op13_token_alignment")}
    assert rows["op11_language_id"].columns == ["doc_id", "held_out", "lang_pred", "score"]
    held = rows["op11_language_id"].filter("held_out").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert rows["op12_filter_audit"].count() == 600 * spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang").distinct().count()
    digest = rows["op13_token_alignment"].filter("n_groups > 0").first()["groups_sha256"]
    assert len(digest) == len(hashlib.sha256().hexdigest())


# Token counts


def test_white_space_runs_take_linear_time():
    table, library = PrefixCounter(JSON), Tokenizer.from_file(JSON)
    for text in (" \n" * 100_000, "a" + " \n" * 100_000, "\n" * 100_000 + "b", "x" + " \t" * 100_000 + "y" + " " * 50_000):
        assert table.summary(text, (512,))[0] == len(library.encode(text, add_special_tokens=False).ids)
    for text in (" \n" * 40, "a" + "\n " * 20 + "b", "x  y\n\n  z \n"):
        assert table.counts(text).tolist() == [len(library.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]


# Toxicity


def _labelled(spark, n=400):
    """English-like texts; a fifth are abusive with one of several insults, some of them misspelt."""
    rng, words = random.Random(9), [a + b for a in ("ba", "lo", "mi", "tar", "ven", "sol") for b in ("ren", "ting", "der", "la", "mos", "ker", "tal")]
    insults, rows, labels = ["dumbhead", "fartface", "ratbrain", "pigsnout"], [], []
    for i in range(n):
        text, toxic = [rng.choice(words) for _ in range(40)], int(i % 5 == 0)
        if toxic:
            for _ in range(2):
                insult = rng.choice(insults)
                if rng.random() < 0.3:
                    k = rng.randrange(1, len(insult) - 1)
                    insult = insult[:k] + insult[k + 1 :]
                text.insert(rng.randrange(40), insult)
        elif i % 7 == 0:
            text.insert(5, "ratbrains")  # an ordinary word beside an insult
        rows.append((i, " ".join(text), "en"))
        labels.append((i, 1, toxic))
    return _docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), words


def test_misspelling_raises_and_quotation_lowers_the_score(spark):
    from lexmill.llm.toxicity import fit_toxicity, score_toxicity

    docs, labels, words = _labelled(spark)
    model = fit_toxicity(docs, labels, F.lit(True))
    assert (model.coefficients >= 0).all() and model.coefficients[0] > 0 and "ratbrains" in model.ordinary
    plain = " ".join(words[:30])
    score = lambda text: model.probability(np.array([model.features(text)]))[0]
    direct, misspelt = score(f"{plain} dumbhead {plain}"), score(f"{plain} dumbhed {plain}")
    assert score(plain) == score(f"{plain} ratbrains {plain}") < misspelt < direct
    for quoted in ('"you dumbhead"', "“dumbhead”", "„dumbhead“", "« dumbhead »", "‘dumbhead’", "'you dumbhead'", "nannte ihn dumbhead", "le mot dumbhead"):
        assert score(f"{plain} {quoted} {plain}") < direct, quoted
    for open_ in ("c'est un dumbhead qui n'a rien", '" dumbhead', "« dumbhead", "d'un dumbhead l'autre"):  # no paired marks
        assert model.features(f"{plain} {open_} {plain}")[0] == model.features(f"{plain} dumbhead {plain}")[0], open_
    odd = score_toxicity(_docs(spark, [(None, None, None), (1, "", "en"), (1, "", "en"), (2, "dumbhead " * 200_000, "en")]), model).collect()
    assert len(odd) == 4 and all(0 <= r.score <= 1 for r in odd) and [r.predicted for r in odd if r.doc_id == 2] == [1]
    assert score_toxicity(docs.limit(0), model).count() == 0

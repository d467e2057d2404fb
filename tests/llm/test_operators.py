"""Operators of the language-model package against brute force, on small tables with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import attention, chat, decontaminate, language, linkgraph, lm, minhash, packing, records, repetition, secrets
from lectern.llm import words as w
from lectern.llm.queries import VOCABULARY, remainder
from lectern.llm.tokenizing import Ids
from lectern.session import workspace

PATH = public_tokenizers.path(VOCABULARY)
WORD = r"[^\x20\x09-\x0D]+"
SMALL = {c: c + 32 for c in range(65, 91)}


def awkward() -> list[tuple]:
    """Nulls, empty and odd texts, repeated rows, one long text."""
    rnd = random.Random(7)
    vocabulary = ["a", "Bb", "é", "the", "x#", "你好", "\x0b", "\n", "  ", "of,", "don't", "42", "½", "​"]
    texts = [None, "", " ", "\n\n", "one", "one two", "\x00", "A.", "!!!"]
    texts += ["".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", "\n", ""]) for _ in range(rnd.randint(0, 150))) for _ in range(60)]
    texts.append(" ".join(f"w{rnd.randint(0, 3000)}" for _ in range(30000)))
    rows = [(i, t, rnd.choice(["en", "fr", None]), "src", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[20], (None, texts[21], "en", None, 3), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(awkward(), SCHEMA)
    # names the operators use inside
    return frame.select("*", F.lit(1).alias("row"), F.lit("x").alias("rep"), F.lit(0).alias("label"), F.lit("k").alias("key"), F.lit(2).alias("bands")).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(frame):
    return collections.Counter(tuple(r) for r in frame.collect())


# ---- 9: repetition -------------------------------------------------------------------------------------------------

def brute_repetition(text):
    text = text or ""
    words = re.findall(WORD, text)
    grams = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, lines, line_chars = set(), 0, 0
    for line in text.split("\n"):
        own = re.findall(WORD, line)
        if own:
            lines += line in seen
            line_chars += sum(map(len, own)) if line in seen else 0
            seen.add(line)
    chars = sum(map(len, words))
    shares = []
    for n, _ in repetition.Limits().coverage:
        once, later = set(), set()
        for i in range(len(words) - n + 1):
            gram = tuple(words[i:i + n])
            later |= set(range(i, i + n)) if gram in once else set()
            once.add(gram)
        shares.append(sum(len(words[i]) for i in later) / max(chars, 1))
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    limits = repetition.Limits()
    good = line_chars / max(chars, 1) <= limits.lines and all(s <= m for s, (_, m) in zip(shares, limits.coverage, strict=True))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (len(words), chars, symbols, lines, len(inside), failed, line_chars / max(chars, 1), tuple(shares), good and not failed)


def test_repetition_agrees_with_brute_force(docs, empty):
    found = collections.Counter((r[0], *r[1:8], tuple(r[8]), r[9]) for r in repetition.repetition(docs).collect())
    assert found == collections.Counter((i, *brute_repetition(t)) for i, t, *_ in awkward())
    assert repetition.repetition(empty).count() == 0


def test_rolled_hashes_are_those_of_the_runs():
    block = next(w.blocks(iter([pa.record_batch({"text": ["a b c a b c", "", None, "b c a b", "c"]})])))
    words = block.words()
    total = w.rolling(words)
    spoken = [*"abcabcbcabc"]
    for n in (1, 2, 3, 5):
        at, value = w.rolled(words, total, n)
        assert at.tolist() == [k for k in range(11) if k + n <= (6 if k < 6 else 10 if k < 10 else 11)]
        runs = ["".join(spoken[k:k + n]) for k in at]
        assert len(set(runs)) == len(set(value.tolist())) == len(set(zip(runs, value.tolist(), strict=True)))


def test_blocks_do_not_change_words():
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t, *_ in awkward()])], ["text"])
    whole = next(w.blocks(iter([batch]))).words().hash
    parts = np.concatenate([b.words().hash for b in w.blocks(iter([batch]), limit=50)])
    assert (whole == parts).all()


# ---- 6: near-duplicates ----------------------------------------------------------------------------------------------

def brute_components(rows, n, percent):
    sets = collections.defaultdict(set)
    for i, text, *_ in rows:
        words = re.findall(WORD, (text or "").translate(SMALL))
        sets[i] |= {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())
    root = {i: i for i in sets}
    for (i, a), (j, b) in itertools.combinations(sorted((k, v) for k, v in sets.items() if k is not None), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            low, high = sorted((root[i], root[j]))
            root = {k: low if v == high else v for k, v in root.items()}
    return root, {i: len(s) for i, s in sets.items()}


def copies():
    """Groups of near copies around bases, with chains and texts just under the threshold."""
    rnd = random.Random(11)
    rows = []
    for group in range(12):
        base = [f"g{group}w{rnd.randint(0, 400)}" for _ in range(rnd.choice([2, 12, 60, 200]))]
        for _ in range(rnd.choice([1, 2, 5, 40])):
            own = list(base)
            for _ in range(int(len(own) * rnd.choice([0, 0.02, 0.03, 0.05]))):
                own[rnd.randrange(len(own))] = f"n{rnd.random()}"
            base = own if rnd.random() < 0.2 else base
            rows.append((1000 + len(rows), " ".join(own)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_components_are_exact(spark, n, percent):
    rows = [*copies(), *[(i, t) for i, t, *_ in awkward() if i != 20]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    root, size = brute_components(rows, n, percent)
    found = minhash.near_duplicates(frame, minhash.Near(words=n, percent=percent)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.component_id == root[r.doc_id] and r.kept == (r.doc_id == root[r.doc_id] or r.doc_id is None)
        assert r.doc_id is None or r.n_shingles == size[r.doc_id]


def test_near_duplicates_of_odd_tables(docs, empty):
    rows = minhash.near_duplicates(docs).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, *_ in awkward())
    assert minhash.near_duplicates(empty).count() == 0


# ---- 2: decontamination ----------------------------------------------------------------------------------------------

def test_masks_catch_every_two_replacements():
    for gone in itertools.combinations(range(decontaminate.STRETCH), decontaminate.REPLACED):
        assert any(all(bit == "0" or at + k not in gone for k, bit in enumerate(mask)) for mask in decontaminate.MASKS for at in range(decontaminate.STRETCH - len(mask) + 1))


def test_contamination_agrees_with_brute_force(spark, docs, empty):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 40))) for _ in range(8)]
    items += [items[0], None, ""]
    items += ["w1 w2 w3 w4 w5", "w7 W8, w9", "w3"]
    rows = [(600, "w7 w8 w9"), (601, "w7 w8 w9 w9"), (602, "W3"), (603, "x w1 w2 w3 w4 w5 w1 w2 w3 w4 w5"), (604, "w1 w2 w3 w4")]
    for d in range(100):
        tokens = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 120))]
        for _ in range(rnd.randint(0, 2)):
            own = rnd.choice(items[:9]).split()
            start = rnd.randint(0, max(0, len(own) - 10))
            own = own[start:start + rnd.randint(8, 40)]
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            place = rnd.randint(0, len(tokens))
            tokens[place:place] = own
        rows.append((d, " ".join(tokens).upper() if d % 3 else ", ".join(tokens)))
    rows += [(500, None), (501, ""), (None, items[1]), (3, rows[8][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1))
    bench = spark.createDataFrame([*enumerate(items), (None, "x")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.matched, r.doc_start, r.item_start) for r in decontaminate.contamination(frame, bench).collect()}
    expected = {}
    for (d, text), (i, item) in itertools.product(rows, enumerate(items)):
        a, b = (re.findall("[a-z0-9]+", (t or "").lower()) for t in (text, item))
        for shift in range(-len(b), len(a) + 1) if d is not None else []:
            same = [0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(len(b))]
            good = [k for k in range(len(b) - 12) if k + shift >= 0 and k + shift + 13 <= len(a) and sum(same[k:k + 13]) >= 11]
            if 0 < len(b) < 13 and sum(same) == len(b) and (len(b) >= 4 or len(a) == len(b)):
                expected[d, i] = max(expected.get((d, i), (0, -shift, 0)), (len(b), -shift, 0))
            if good:
                covered = {x for k in good for x in range(k, k + 13)}
                value = (sum(same[k] for k in covered), -(good[0] + shift), -good[0])
                expected[d, i] = max(expected.get((d, i), value), value)
    assert found == {k: (m, -s, -t) for k, (m, s, t) in expected.items()}
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0


# ---- 1: secrets ------------------------------------------------------------------------------------------------------

def keys():
    rnd = random.Random(5)
    alphabet = secrets.ALPHABETS["base62"]
    key = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    texts = [f"see {key(40)} there" for _ in range(30)] + ["password = short", "API_KEY:'abcdefgh12' Token=\"zzzzzzzz\"", "token= secret: abcdefghij", "AKIA" + "Z9" * 8 + " AKIA12",
             "é" * 5 + "0123456789abcdef" * 2, "passſwd=abcdefghijk", "secretsecret==abcdefgh", None, "", "token=" + "ab12" * 10]
    return list(enumerate(texts)) + [(3, texts[3]), (None, texts[33])]


def test_base_spans_and_discoveries(spark, empty):
    rows = keys()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    found = collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base, r.n_random) for r in secrets.scan(frame).withColumn("base", secrets.joined("base")).collect())
    expected = collections.Counter()
    for i, text in rows:
        text = text or ""
        spans = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
        spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        spans.sort(key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))
        counts = collections.Counter(s[0] for s in spans)
        expected[i, counts["assign"], counts["access"], counts["hex"], ",".join(f"{k}:{s}:{e}" for k, s, e in spans)] += 1
    assert collections.Counter(k[:5] for k in found.elements()) == expected
    assert sum(k[5] for k in found.elements()) >= 27  # of 31 random keys
    assert secrets.scan(empty).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256)).first()[0]


def test_keys_in_paths_and_beside_hashes_are_candidates():
    rnd = random.Random(11)
    for _ in range(20):
        key = "".join(rnd.choice(secrets.ALPHABETS["base62"]) for _ in range(40))
        for before, after in (("example/my-app/k/", ""), ("a/b_c/k/", "/x-y"), ("0123456789abcdef" * 2 + "/", ""), ("", "/" + "0123456789abcdef" * 2)):
            text = f"see {before}{key}{after} now"
            at = text.index(key)
            order = secrets.battery_values(key, "base62", secrets.Battery())[0]
            found = list(secrets.candidates(text, secrets.base_spans(text), secrets.Battery()))
            assert order < 0.01 or any(s <= at and at + 40 <= e for s, e, *_ in found)
    whole = "".join(rnd.choice(secrets.ALPHABETS["base62"]) for _ in range(30)) + "/" + "".join(rnd.choice(secrets.ALPHABETS["base62"]) for _ in range(30))
    assert [x[:2] for x in secrets.candidates(whole, [], secrets.Battery(order=0))] == [(0, 61)]


def test_redaction_keeps_everything_else(spark, docs):
    frame = spark.createDataFrame(keys(), "doc_id long, text string").withColumn("other", F.lit(1))
    out = {r.doc_id: r.text for r in secrets.redact(frame).filter("doc_id is not null").collect()}
    assert out[30] == "password = short" and out[31] == "[secret]' [secret]\"" and out[37] is None and out[39] == "[secret]"
    assert by_row(secrets.redact(docs)) == by_row(docs)


def test_ordinary_identifiers_are_not_discovered():
    battery = secrets.Battery()
    for token in ("ThisIsCamelCaseIdentifier2024", "some_long_snake_case_identifier_v2", "20240101T120000Z-report-final", "a" * 30 + "1"):
        name = secrets.encoding(token)
        order, ordinary = secrets.battery_values(token, name, battery)
        assert order < battery.order or ordinary > 0.01
    assert secrets.encoding("donaudampfschifffahrtsgesellschaft") is None


# ---- 4, 5: records and packing -----------------------------------------------------------------------------------------

def library_ids(text, end):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_ids_are_those_of_the_library():
    rnd = random.Random(5)
    parts = ["a", "B", " ", " ", "\n", "\t", "'s", "'ll", "’", "é", "1", "23", "²", "½", "_", "__", ".", "!?", "\x0b", "\x1c", "\x85", "\xa0", "你", "ª", "  ", "\r\n", "×", "<|endoftext|>", "ǅ", "٣", "Ⅷ", "–"]
    ids = Ids.of(PATH)
    for k in range(3000):
        text = "".join(rnd.choice(parts[:18] if k % 2 else parts) for _ in range(rnd.randint(0, 14)))
        assert ids.encode(text) == ids.whole(text)


def test_records_round_trip(spark, docs, empty):
    manifest = records.write_records(docs, workspace(spark), PATH, files=3)
    rows = records.read_records(spark, manifest).collect()
    expected = sorted(((i, library_ids(t, 0).tobytes()) for i, t, *_ in awkward()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in rows) == collections.Counter(expected)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ordered == [i for i, _ in expected]
    again = records.read_shuffled(spark, manifest, 5).collect()
    assert by_row_list(again) == by_row_list(rows) and [r.start for r in again] != [r.start for r in rows]
    assert records.read_records(spark, records.write_records(empty, workspace(spark), PATH)).count() == 0


def test_one_hot_id_is_spread_over_files_and_ids_are_numbers(spark):
    frame = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 1500).cast("string")).alias("text"))
    manifest = records.write_records(frame, workspace(spark), PATH, files=8).collect()
    sizes = [r["n_records"] for r in manifest]
    assert sum(sizes) == 4000 and len(sizes) == 8 and max(sizes) < 1200
    with pytest.raises(TypeError, match="whole numbers"):
        records.write_records(frame.withColumn("doc_id", F.lit("a")), workspace(spark), PATH)


def by_row_list(rows):
    return collections.Counter(tuple(map(lambda v: bytes(v) if isinstance(v, bytearray) else v, r)) for r in rows)


def test_damaged_record_is_refused():
    payload = records.LEAD.pack(2, 1, 7) + np.array([1, 2], "<u2").tobytes()
    length = len(payload).to_bytes(8, "little")
    frame = length + records.masked(length).to_bytes(4, "little") + payload + records.masked(payload).to_bytes(4, "little")
    assert records.parse(frame)[0] == 7
    for k in range(len(frame)):
        with pytest.raises(ValueError):
            records.parse(frame[:k] + bytes([frame[k] ^ 1]) + frame[k + 1:])


def test_packing_covers_every_id_once(spark, docs, empty):
    pieces = packing.pack(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), PATH, packing.Packing(capacity=256, windows=16)).collect()
    texts = {i: t for i, t, *_ in awkward() if i is not None}
    seen = collections.defaultdict(list)
    windows = collections.defaultdict(list)
    for p in pieces:
        seen[p.doc_id].append((p.start, bytes(p.ids)))
        windows[p.sequence_id].append((p.offset, p.length))
        assert p.length * 4 == len(p.ids)
    assert set(seen) == set(texts)
    for i, own in seen.items():
        assert b"".join(x for _, x in sorted(own)) == library_ids(texts[i], 1).tobytes()
    for own in windows.values():
        ends = list(itertools.accumulate(n for _, n in sorted(own)))
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 256
    assert packing.pack(docs, PATH).agg(F.sum("length")).first()[0] == sum(len(library_ids(t, 1)) for _, t, *_ in awkward())
    assert packing.pack(empty, PATH).count() == 0


def test_differencing_is_nearly_equal():
    rnd = random.Random(2)
    lengths = [rnd.randint(1, 700) for _ in range(400)]
    parts = packing.differencing(lengths, 40)
    assert sorted(i for p in parts for i in p) == list(range(400))
    sums = [sum(lengths[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= 0.003 * sum(sums) / 40
    assert packing.differencing([5], 1) == [[0]] and sorted(packing.differencing([5, 5], 3)) == [[], [0], [1]]


# ---- 7: language -------------------------------------------------------------------------------------------------------

def test_language_separates_and_rejects(spark, docs, empty):
    rnd = random.Random(4)
    syllables = {"en": "the ing tion and er".split(), "de": "sch ein ung lich der".split(), "ру": "при ство ени ать ого".split()}
    rows = [(i, " ".join("".join(rnd.choice(syllables[lang]) for _ in range(3)) for _ in range(40)), lang) for i, lang in enumerate(list(syllables) * 30)]
    profiles = language.fit(spark.createDataFrame([*rows[:60], (90, None, "en"), (91, "abc", None), (92, "123", "xx")], "doc_id long, text string, lang string"))
    assert profiles.languages == ("de", "en", "ру")
    test = spark.createDataFrame([*rows[60:], (100, None, None), (101, "12 !", "en"), (None, "the", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(test, profiles, ("doc_id",)).collect()}
    assert all(found[i][0] == lang and 0 <= found[i][1] <= 1 for i, _, lang in rows[60:])
    assert found[100] == found[101] == ("und", 0.0) and len(found) == len(rows) - 60 + 3
    nothing = language.fit(empty)
    assert nothing.languages == () and {r[0] for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(empty, profiles, ("doc_id",)).count() == 0


def test_bundles_are_sums_of_bound_vectors():
    block = next(w.blocks(iter([pa.RecordBatch.from_arrays([pa.array(["Ab я"])], ["text"])])))
    gram, first, _ = language._grams(block)
    own = gram[first[0]:first[1] - 2]
    code = [0, ord("a"), ord("b"), 0, ord("я"), 0]
    letters = dict(zip(code, language.letters(np.array(code), 64).astype(int), strict=True))
    expected = sum(np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(code, code[1:], code[2:], strict=False))
    assert (language._vectors(own, 64).sum(0, dtype=int) == expected).all()


def test_every_letter_has_a_vector_of_its_own():
    points = np.array([*range(97, 123), *range(0x430, 0x450), *range(0xAC00, 0xAC00 + 11172), *range(0x4E00, 0x5200)])
    vectors = language.letters(points, 1024).astype(np.float32)
    assert set(np.unique(vectors)) == {-1.0, 1.0}
    some = vectors[:1500]
    cosine = some @ some.T / 1024
    np.fill_diagonal(cosine, 0)
    assert np.abs(cosine).max() < 0.2  # near right angles
    assert len(np.unique(vectors, axis=0)) == len(points)


def test_languages_of_one_script_and_single_trigrams(spark):
    rnd = random.Random(9)
    letters = {"uk": "іїєґаонвр", "bg": "ъщяаонвре", "ko1": [chr(0xAC00 + 7 * k) for k in range(40)], "ko2": [chr(0xAC00 + 7 * k + 3) for k in range(40)]}
    spoken = {lang: ["".join(rnd.choice(own) for _ in range(4)) for _ in range(30)] for lang, own in letters.items()}
    rows = [(i, " ".join(rnd.choice(spoken[lang]) for _ in range(20)), lang) for i, lang in enumerate(list(letters) * 20)]
    profiles = language.fit(spark.createDataFrame([*rows[:40], (1, "x", "one")], "doc_id long, text string, lang string"))
    found = language.identify(spark.createDataFrame([*rows[40:], (900, "x", "?")], "doc_id long, text string, lang string"), profiles, ("doc_id", "lang")).collect()
    assert all(r["lang_pred"] == ("one" if r["lang"] == "?" else r["lang"]) for r in found)


def test_held_out_accuracy_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = remainder("doc_id", 5)
    found = language.identify(docs.filter(fold == 0), language.fit(docs.filter(fold != 0)), ("lang",)).filter("lang_pred <> 'und'").collect()
    assert len(found) > 100 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)


# ---- 8: scores ---------------------------------------------------------------------------------------------------------

def test_base_scores_and_model(spark, docs, empty):
    for common in (1 << 20, 8):
        found = lm.score(docs, remainder("doc_id", 7) != 2, PATH, lm.Scoring(common=common, rounds=1)).collect()
        counts = collections.Counter()
        for i, text, *_ in awkward():
            if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
                counts.update([*re.findall(WORD, (text or "").translate(SMALL)), None])
        total, distinct = sum(counts.values()), len(counts)
        expected = collections.defaultdict(list)
        for i, text, *_ in awkward():
            words = [*re.findall(WORD, (text or "").translate(SMALL)), None]
            expected[i].append((len(words), sum(counts[x] > 0 for x in words), sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in words)))
        assert len(found) == len(awkward())
        for r in found:
            assert r.train_tokens == total and r.score < 0
            assert any(r.n_tokens == n and r.n_known == k and abs(r.base_score - s) < 1e-6 * max(1, abs(s)) for n, k, s in expected[r.doc_id])
    assert lm.score(empty, F.lit(True), PATH).count() == 0
    assert lm.score(docs.limit(5), F.lit(False), PATH).filter("train_tokens = 0").count() == 5


def counted(monkeypatch, frame, training):
    """Counts of ids that the model starts from."""
    seen, initial = [], attention.initial
    monkeypatch.setattr(lm.at, "initial", lambda counts, *more: seen.append(counts) or initial(counts, *more))
    lm.score(frame, training, PATH, lm.Scoring(rounds=1))
    return seen[0]


def test_model_learns_from_every_id_of_training_texts(monkeypatch, docs):
    expected = collections.Counter()
    for i, text, *_ in awkward():
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            expected.update([50256, *library_ids(text or "", 50256)])
    assert counted(monkeypatch, docs, remainder("doc_id", 7) != 2) == expected


def test_long_texts_without_blanks_are_learned_whole(spark, monkeypatch):
    parts = ["".join(chr(0x4e00 + 500 * k + i % 499) for i in range(5000)) for k in range(3)]
    text = "\n".join(parts)
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert counted(monkeypatch, frame, F.lit(True)) == collections.Counter([50256, *library_ids(text, 50256)])


def test_windows_have_every_target_once():
    lengths = np.array([2, 33, 34, 3, 97, 66])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    start, targets = lm.windows(offsets, 32)
    found = np.concatenate([np.arange(a + 1, a + n + 1) for a, n in zip(start, targets, strict=True)])
    assert found.tolist() == [x for x in range(offsets[-1]) if x not in offsets] and targets.max() == 32


def test_model_is_a_distribution_and_windows_score_once():
    rng = np.random.default_rng(1)
    model = attention.initial({int(i): int(n) for i, n in zip(rng.integers(0, 50257, 3000), rng.integers(1, 50, 3000), strict=True)}, attention.Shape(width=8, window=6, step=4))
    history = rng.integers(0, 3000, 6)
    many = np.arange(attention.VOCABULARY)
    p = np.exp(attention.log_probabilities(model, np.repeat(history[None], len(many), 0), many[:, None]).astype(np.float64))
    assert abs(p.sum() - 1) < 1e-3
    texts = [rng.integers(0, 50257, n) for n in (2, 5, 9, 30)]
    found = lm.text_scores(model, texts, batch=3)
    for text, value in zip(texts, found, strict=True):
        numbers, total = model.rank[text], 0.0
        for t in range(1, len(text)):
            left = (t - 1) // 4 * 4 - 2
            shown = np.full((1, 6), -1)
            shown[0, :t - left] = [numbers[p] if p >= 0 else -1 for p in range(left, t)]
            targets = np.full((1, 4), -1)
            targets[0, t - left - 3] = numbers[t]
            total += attention.log_probabilities(model, shown, targets).sum()
        assert abs(total - value) < 1e-3 * len(text)


def test_gradients_and_learning():
    rng = np.random.default_rng(0)
    model = attention.initial({}, attention.Shape(width=8, window=8))
    ids, weight = rng.integers(0, 2500, (3, 9)), np.ones((3, 8))
    weight[0, 5:] = 0
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    _, grads = attention.gradient(model, ids, weight)
    for name, grad in grads.items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        ends = []
        for step in (1e-4, -2e-4):
            model.weights[name][at] += step
            ends.append(attention.gradient(model, ids, weight)[0])
        model.weights[name][at] += 1e-4
        assert abs((ends[0] - ends[1]) / 2e-4 - grad[at]) < 1e-4 * max(1, abs(grad[at]))
    adam = attention.Adam(attention.initial({}, attention.Shape(width=8, window=8)))
    losses = [adam.step(ids, weight) for _ in range(60)]
    assert losses[-1] < 0.3 * losses[0]


# ---- 3: perspectives ---------------------------------------------------------------------------------------------------

def test_every_participant_gets_the_dialogue(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|end|>"), (1, 3, "ann", None), (2, 1, "ann", ""), (2, None, None, "x"), (3, 1, "system", "alone"), (None, 1, "ann", "é"), (1, 1, "ann", "hi")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("perspective"), F.lit(1).alias("length"))
    found = collections.defaultdict(list)
    for r in chat.rotate(frame).collect():
        found[r.conv_id, r.perspective].append(r)
    assert set(found) == {(1, "ann"), (1, "bob"), (2, "ann"), (2, ""), (None, "ann")}
    for (_, who), own in found.items():
        own.sort(key=lambda r: r.start)
        whole = "".join(r.rendered for r in own)
        for r in own:
            assert whole[r.start:r.start + r.length] == r.rendered
            trained = whole[r.mask_start:r.mask_start + r.mask_length]
            assert trained == (r.rendered.removeprefix("<|assistant|>\n") if r.seat == "assistant" else "")
            assert (r.seat == "assistant") == r.rendered.startswith("<|assistant|>")
        assert whole.count("<|end|>") == len(own)
    ann = "".join(r.rendered for r in found[1, "ann"])
    assert ann.startswith("<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n") and "<|user name=bob|>\nyo <​|end|><|end|>" in ann
    assert chat.rotate(frame.limit(0)).count() == 0


# ---- 10: link graph ------------------------------------------------------------------------------------------------------

def test_rules_and_flow(spark):
    link = '<a href="http://{}/x">y</a>'
    rows = [(1, "http://A.org/x?q", None), (2, "https://example.org/es/1", None), (3, "x.example.org/none", ""), (4, None, None), (5, "http://b.com/fr/1", link.format("friend.net")),
            (6, "http://bad.com/de/", None), (7, "http://friend.net/", None), (8, "http://foe.net/p", link.format("bad.com") * 3 + '<img src="//bad.com">'), (9, "http://other.net#f", "<a href='/in'>"),
            (10, "http://example.org/en/12", None), (11, "http://org", None), (12, "http://example.com.org/fr/", None), (13, "http://bad.com/en/", None), (1, "http://A.org/x?q", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("z"))
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in linkgraph.filter_urls(frame).collect()}
    assert found == {1: ("a.org", "/x", "org/", "allow"), 2: ("example.org", "/es/1", "example.org/es/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
                     5: ("b.com", "/fr/1", "com/fr/", "allow"), 6: ("bad.com", "/de/", "com/de/", "block"), 7: ("friend.net", "/", None, "allow"), 8: ("foe.net", "/p", None, "block"),
                     9: ("other.net", "", None, "allow"), 10: ("example.org", "/en/12", "example.org/en/1", "block"), 11: ("org", "", None, "allow"), 12: ("example.com.org", "/fr/", "org/", "allow"),
                     13: ("bad.com", "/en/", None, "block")}
    assert linkgraph.filter_urls(frame).count() == len(rows) and linkgraph.filter_urls(frame.limit(0)).count() == 0
    plan = linkgraph.filter_urls(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_flow_reaches_as_far_as_the_links(spark):
    page = lambda i, host, to: (i, f"http://{host}/", f'<a href="http://{to}/">')
    # distrust goes against the links: h19 -> ... -> h0 -> bad.com
    rows = [(100, "http://bad.com/de/", ""), page(0, "h0.net", "bad.com"), *(page(i, f"h{i}.net", f"h{i - 1}.net") for i in range(1, 20))]
    rows += [(99, "http://free.net/", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.verdict for r in linkgraph.filter_urls(frame).collect()}
    assert found == {100: "block", 99: "allow", **dict.fromkeys(range(20), "block")}


def brute_ranks(weights, links, flow):
    base = {h: n * flow.unit * (100 - flow.damping) // 100 for h, n in weights.items() if n}
    out = collections.Counter(a for a, _ in links)
    ranks = dict(base)
    for _ in range(flow.rounds):
        new = collections.Counter(base)
        for a, b in links:
            new[b] += ranks.get(a, 0) * flow.damping // (100 * out[a])
        ranks = {h: r for h, r in new.items() if r}
    return ranks


@pytest.mark.parametrize("seed, chain", [(1, 0), (3, 200)])
def test_ranks_on_linked_pages_agree_with_brute_force_and_sql(spark, tmp_path, seed, chain):
    import duckdb
    rnd = random.Random(seed)
    flow = linkgraph.Flow(rounds=9)
    hosts = [f"h{i}.{rnd.choice(['org', 'com', 'net', 'net'])}" for i in range(30)]
    rows = []
    for i in range(120):
        own = rnd.choice(hosts)
        to = [rnd.choice(hosts) for _ in range(rnd.randint(0, 4))]
        rows.append((i, f"http://{own}/{rnd.choice(['fr/', 'de/', 'x', ''])}", "".join(f'<a href="https://{t}/p">' for t in to)))
    rows += [(1000 + i, f"http://c{i}.net/", f'<a href="http://{f"c{i - 1}.net" if i else hosts[0]}/">') for i in range(chain)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    made = []
    kept = linkgraph.stable
    linkgraph.stable = lambda df: made.append(1) or kept(df)
    try:
        found = {r.page_id: (r.verdict, r.trust, r.distrust) for r in linkgraph.filter_urls(frame, flow=flow).collect()}
    finally:
        linkgraph.stable = kept
    assert len(made) <= 2 * flow.rounds + 8  # whatever the length of the chain
    good, bad, links, ruled = collections.Counter(), collections.Counter(), set(), {}
    for i, url, html in rows:
        host, _, path = url.removeprefix("http://").partition("/")
        fit = "allow" if host.endswith(".org") else "allow" if host.endswith(".com") and path.startswith("fr/") else "block" if host.endswith(".com") and path.startswith("de/") else None
        ruled[i] = host, fit
        good[host] += fit == "allow"
        bad[host] += fit == "block"
        links |= {(host, t) for t in re.findall('//([^/"]+)/', html) if t != host}
    trust, doubt = brute_ranks(good, links, flow), brute_ranks(bad, {(b, a) for a, b in links}, flow)
    g, b = max(1, sum(good.values())), max(1, sum(bad.values()))
    for i, (host, fit) in ruled.items():
        t, d = trust.get(host, 0), doubt.get(host, 0)
        assert found[i] == (fit or ("block" if d and d * g >= flow.share * t * b else "allow"), t // g, d // b)
    assert len({v for v, _, _ in found.values()}) == 2
    frame.write.parquet(f"{tmp_path}/pages")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    names = [c[0] for c in con.execute(linkgraph.sql(flow=flow) + " LIMIT 0").description]
    told = {r[names.index("page_id")]: tuple(r[names.index(c)] for c in ("verdict", "trust", "distrust")) for r in con.execute(linkgraph.sql(flow=flow)).fetchall()}
    assert told == found


def test_flow_does_not_depend_on_the_size_of_the_seeds(spark):
    seeds = spark.createDataFrame([("small", 1), ("large", 10 ** 10)], "host string, weight long")
    links = spark.createDataFrame([(f"{a}{i}" if i else "small", f"{b}{i + 1}") for i in range(6) for a in "xy" for b in "xyzuvw"], "`from` string, `to` string").distinct()
    ranks = {r.host: int(r.rank) for r in linkgraph._rank(seeds, links, linkgraph.Flow()).collect()}
    alone = {r.host: int(r.rank) for r in linkgraph._rank(seeds.filter("weight = 1"), links, linkgraph.Flow()).collect()}
    assert ranks.pop("large") and ranks == alone and min(ranks.values()) > 0 and "x6" in ranks


def test_training_on_copies_of_one_text_learns_it():
    """Large logits were cut off, which made the largest ones equal: on copies the loss rose again without end."""
    rng = np.random.default_rng(5)
    text = rng.integers(0, 400, 600).astype(np.int32)
    model = attention.initial({i: 5 for i in range(400)})
    adam = attention.Adam(model)
    for _ in range(500):
        start = rng.integers(0, 567, 64)
        last = adam.step(text[start[:, None] + np.arange(33)], np.ones((64, 32), np.float32))
    assert last < 1
    assert lm.text_scores(adam.model, [text]).sum() > -600
    other = rng.integers(0, 400, 200).astype(np.int32)
    assert lm.text_scores(adam.model, [other]).sum() > 199 * (np.log(attention.MIXED) + np.log(5.01 / (2000 + 0.01 * attention.VOCABULARY)) - 0.1)


def test_biases_are_the_distribution_after_the_id_before():
    model = attention.initial({0: 50, 1: 30, 2: 20, 40000: 7}, attention.Shape(width=8, window=6, step=4))
    numbers = np.array([0, 1, 0, 1, 0, 2, 1, 1, 3], np.int32)
    keys, n = np.unique(attention.pairs(numbers), return_counts=True)
    model = attention.after(model, keys, n)
    for name in ("u1", "u2", "u3", "u4"):
        model.weights[name][:] = 0
    history = np.full((1, 6), -1, np.int32)
    history[0, -1] = 0
    every = np.arange(attention.VOCABULARY)
    p = np.exp(attention.log_probabilities(model, np.repeat(history, len(every), 0), every[:, None]).astype(np.float64)).ravel()
    assert abs(p.sum() - 1) < 1e-3
    alone = (np.array([50, 30, 20]) + 0.01) / (107 + 0.01 * attention.VOCABULARY)
    assert np.allclose(p[:3], (np.array([0, 2, 1]) + attention.PRIOR * alone) / (3 + attention.PRIOR), rtol=1e-3)


def test_units_have_the_ids_of_the_library_and_are_asked_for_once(monkeypatch):
    texts = [text or "" for _, text, *_ in awkward()] + ["  a\n\n b's  it's\t", "\n", "b's a", "x" * 3000 + " b's", "a\x1cb \x1c", "one \u3000 two", " <|endoftext|> "]
    encoder = Ids(PATH)
    end = np.array([50256], "<u2").tobytes()

    def ids():
        batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
        return [x for block in w.blocks(iter([batch])) for x in lm._ids(block, block.words(lower=True), encoder, 50256)]

    expected = [end + library_ids(text, 50256).astype("<u2").tobytes() for text in texts]
    assert ids() == expected
    asked = []
    monkeypatch.setattr(encoder.units, "_split", asked.append)
    assert ids() == expected and not asked
    monkeypatch.undo()
    monkeypatch.setattr("lectern.llm.tokenizing.UNITS", 3)  # forgets with every block
    assert ids() == expected


def test_counts_of_many_blocks_are_one_row_a_word(monkeypatch):
    batch = pa.record_batch([pa.array(["b a A"] * 2000 + [None, ""], pa.string())], ["text"])
    blocks = [pa.record_batch([pa.array(["b a A"] * 10)], ["text"])] * 5
    assert sorted(pa.Table.from_batches(lm._count(iter([batch, *blocks]))).column("c").to_pylist()) == [2050, 4100]
    assert list(lm._count(iter([]))) == []
    monkeypatch.setattr(lm, "TOGETHER", 1)
    assert sum(pa.Table.from_batches(lm._count(iter(blocks))).column("c").to_pylist()) == 150


def test_held_out_texts_score_no_worse_than_their_words(spark):
    """Words of a small vocabulary in a fixed order of kinds: what follows depends on what stood before."""
    rng = np.random.default_rng(3)
    kinds = [["red", "blue", "green", "old"], ["house", "river", "garden", "stone"], ["falls", "waits", "shines", "turns"]]
    rows = [(i, " ".join(kinds[k % 3][rng.integers(4)] for k in range(90))) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = lm.score(frame, remainder("doc_id", 7) != 2, PATH).filter("NOT training").selectExpr("sum(score) s", "sum(base_score) b", "count(score) n", "count(*) rows").first()
    assert found["n"] == found["rows"] > 0 and np.isfinite(found["s"]) and found["s"] > found["b"]

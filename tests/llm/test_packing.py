import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tracewright.llm import packing

TEXTS = [None, "", "a", "It's  the\n\n end's.  ", "x" * 3000, "Überaus schön, élève ñandú 12345 ²³ ½ 漢字 🙂", "a <|endoftext|> b", "tab\tand\r\nlines \x1c\x85\xa0 !'s 's't'", "word " * 4000, "  lead  '  don't 'll"]


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    vocabulary, ranks = packing.default_files()
    slow, fast = Tokenizer.from_file(vocabulary), packing.Tokens(vocabulary, ranks)
    rng = random.Random(1)
    made = ["".join(rng.choice("ab Zé\n\t '!sd1²ñ漢") for _ in range(rng.randrange(60))) for _ in range(500)]
    for text in [*filter(None, TEXTS), *made, "ab c " * 300_000]:
        assert fast(text) == np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:80]


@pytest.mark.parametrize("counts", [{}, {1: 5}, {1024: 3, 7: 1}, {600: 4, 400: 9, 24: 11}, {n: n % 7 + 1 for n in range(1, 1025)}])
def test_plan_places_each_piece_once(counts):
    placed = Counter()
    for pattern, count in packing.plan(counts, 1024):
        assert sum(pattern) <= 1024 and count > 0
        for n in pattern:
            placed[n] += count
    assert placed == Counter({n: c for n, c in counts.items() if c})


def test_plan_leaves_little_room():
    rng = random.Random(2)
    counts = Counter(rng.randrange(1, 1025) for _ in range(100_000))
    packs = sum(c for _, c in packing.plan(counts, 1024))
    assert sum(n * c for n, c in counts.items()) / (packs * 1024) > 0.99


def test_pieces_cover_every_document(spark):
    rows = [(k, t, k) for k, t in enumerate(TEXTS * 3)] + [(0, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    out = packing.pack(docs, with_ids=True).collect()
    again = sorted((r.doc_id, r.start, r.sequence_id, r.offset) for r in packing.pack(docs).collect())
    assert again == sorted((r.doc_id, r.start, r.sequence_id, r.offset) for r in out)
    fast, sequences, whole = packing.Tokens(*packing.default_files()), defaultdict(list), defaultdict(dict)
    for r in out:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        if r.doc_id:
            whole[r.doc_id][r.start] = r.ids
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for k, text, _ in rows:
        if k:
            ids = [i for _, part in sorted(whole[k].items()) for i in part]
            assert np.array(ids, "<u4").tobytes() == fast(text or "") + bytes(4)
    assert sum(r.doc_id == 0 for r in out) == 2


def test_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def naive(counts, most):
    """How full the packs get if each piece, longest first, goes to the shortest pack with room."""
    packs = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [k for k, used in enumerate(packs) if used + length <= most]
            if fits:
                packs[min(fits, key=lambda k: packs[k])] += length
            else:
                packs.append(length)
    return Counter(packs)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_shortest_pack_first(seed):
    rng = random.Random(seed)
    most = rng.choice([10, 64, 1024])
    counts = dict(Counter(min(most, max(1, int(rng.expovariate(3 / most)))) if seed % 2 else rng.randrange(1, most + 1) for _ in range(300)))
    assert Counter({}) + sum((Counter({sum(p): c}) for p, c in packing.plan(counts, most)), Counter()) == naive(counts, most)


def test_one_tokenizer_for_all_texts():
    files = packing.default_files()
    tokens = packing.Tokens(*files)
    assert tokens("a <|endoftext|> b") and packing.Tokens(*files).kept[files[0]] is tokens.kept[files[0]]

"""Operators 3, 6 and 7 against the libraries and brute force."""

import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallgrass.llm.automaton import MergeAutomaton, release, scan
from tallgrass.llm.packing import TightestFit, pack, plan
from tallgrass.llm.piecevocab import Normaliser, PieceVocabulary, decode, digest, encode
from tallgrass.llm.token_count import token_counts
from tallgrass.llm.wordvocab import WordVocabulary

WORD, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = ["", "  ", "don't they'll 'street ''s ,'s 's's x've 'LL", "İstanbul ΣΑΣ ﬁ ½ ² 中文字", "a<|endoftext|>b<|startoftext|><|EndOfText|>", "é é éx", "\x1c\x85b\xa0c　d", "aaaa" * 900, "🎉🎉 hi", "12 3.4e5", "' s 'm''re", "q'", "'", "'r", "▁x ▁▁ y", " " * 40 + "q" + " " * 17, "a\n\nb\t\tc", "x" * 3000 + " th" * 900]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def vocabulary():
    return WordVocabulary(WORD)


@pytest.fixture(scope="module")
def pieces():
    return PieceVocabulary(PIECE)


def test_word_vocabulary_equals_the_library(library, vocabulary):
    want = [e.ids for e in library.encode_batch(ODD, add_special_tokens=False)]
    assert [x.tolist() for x in vocabulary.ids(ODD)] == want
    assert vocabulary.counts(ODD).tolist() == [len(x) for x in want]


def test_piece_vocabulary_equals_the_library(pieces):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = model.encode(ODD)
    assert [x.tolist() for x in pieces.encode(ODD)] == want
    assert [pieces.decode(x) for x in want] == [model.decode(x) for x in want]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abtheino'12 .,-<|>\n\tÉß中"), max_size=60), max_size=4))
def test_random_texts(texts):
    lib, vocab = _cached()
    assert [x.tolist() for x in vocab.ids(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def _cached(store={}):  # noqa: B006
    if not store:
        store["x"] = Tokenizer.from_file(WORD), WordVocabulary(WORD)
    return store["x"]


def test_chunks_and_a_dropped_table_change_nothing(vocabulary):
    buf, _, _ = vocabulary.symbols([" ".join(ODD), "antidisestablishmentarianism" * 40])
    one = vocabulary.automaton.run(buf, 100_000)[1]
    for chunk in (1, 3, 17, 64):
        assert (vocabulary.automaton.run(buf, chunk)[1] == one).all()
    small = WordVocabulary(WORD, max_states=50)
    for _ in range(2):
        assert small.counts(ODD).tolist() == vocabulary.counts(ODD).tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("a ▁▂“é"), max_size=12))
def test_normaliser_transducer(text):
    n = Normaliser(b" ", {"▁".encode(): b" ", "““".encode(): b"q"})
    assert n.run(text.encode()) == (" " + text.replace("▁", " ").replace("““", "q") if text else "").encode()


def test_state_maps_compose_as_serial_runs(vocabulary):
    """The scan gives what composing map after map gives, open maps included."""
    r = np.random.default_rng(4)
    for _ in range(40):
        n, k = int(r.integers(1, 40)), int(r.integers(1, 5))
        after, counts = r.integers(-1 if r.random() < 0.3 else 0, k, (n, k)), r.integers(0, 9, (n, k))
        into = int(r.integers(0, k))
        slot, total = [into], [0]
        for i in range(n - 1):
            total.append(total[-1] + (int(counts[i, slot[-1]]) if slot[-1] >= 0 else 0))
            slot.append(int(after[i, slot[-1]]) if slot[-1] >= 0 else -1)
        got = scan(after, counts, into)
        assert got[0].tolist() == slot and all(a == b for a, b, s in zip(got[1].tolist(), total, slot, strict=True) if s >= 0)
    for text in ("ab" * 3000, "abcdefghij" * 400 + " then words " * 40 + "qz" * 900, "x" * 999):
        buf, _, _ = vocabulary.symbols([text])
        assert (vocabulary.automaton.run(buf, 8)[1] == vocabulary.automaton.run(buf, 100_000)[1]).all()


def test_shortest_path_takes_bytes_only_where_no_piece_has_the_character():
    a = MergeAutomaton([(0, b"a", False), (1, b"b", False), (2, b"ab", False)], lambda x, y: (x, y) != (0, 1), by_char=True)
    for text, want in (("ab", [2, -1]), ("aéab", [0, -2, -1, 2, -1]), ("ba", [1, 0])):
        buf = np.frombuffer(text.encode(), np.uint8)
        states, total = a.run(buf)
        assert a.trace(buf, states).tolist() == want and total[-1] == sum(x >= 0 for x in want) + 2 * want.count(-2)


def test_automaton_without_pieces_for_a_character():
    a = MergeAutomaton([(0, b"a", False)], lambda x, y: True, by_char=True)
    states, made = a.run(np.frombuffer("aé".encode(), np.uint8))
    assert made[-1] == 3 and a.trace(np.frombuffer("aé".encode(), np.uint8), states).tolist() == [0, -2, -1]


def test_release_gives_back_what_the_tables_took(vocabulary):
    def held():
        return sum(int(x) for x in re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())) / 1024

    r = np.random.default_rng(6)
    texts = ["".join(map(chr, r.integers(97, 123, 60_000))) for _ in range(4)]
    release()
    before = held()
    counts, grown = vocabulary.counts(texts).tolist(), held()
    assert len(vocabulary.automaton._memo)
    release()
    assert not vocabulary.automaton._memo and held() - before < (grown - before) / 2
    assert vocabulary.counts(texts).tolist() == counts


def test_a_transition_is_one_number_and_large_changes_widen_it():
    """300 pieces are taken back at once where only one long piece can close the word."""
    word = b"a" * 300 + b"b"
    for chunk in (1, 16, 256, 1000):
        a = MergeAutomaton([(0, b"a", False), (1, word, True), (2, b"ab", True)], lambda x, y: y == 0 or x == -1, closing=True)
        total = a.run(np.frombuffer(b"ab\xffab\xff", np.uint8), chunk)[1]
        assert total[[2, 5]].tolist() == [1, 2] and a._table.itemsize == 4
        buf = np.frombuffer(b"ab\xff" + word + b"\xffab\xff", np.uint8)
        for _ in range(2):
            total = a.run(buf, chunk)[1]
            assert total[[2, 303, 304, 307]].tolist() == [1, 301, 2, 3] and a._table.itemsize == 8


def test_counts_of_a_table(table, rows, library):
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(table(rows)).collect())
    want = [len(e.ids) for e in library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert got == sorted((i or 0, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, want, strict=True))
    assert token_counts(table([])).count() == 0


def test_sentencepiece_of_a_table(table, rows):
    docs = table(rows)
    assert all(r["round_trip"] for r in digest(docs).collect()) and digest(docs).count() == len(rows)
    back = decode(encode(docs))
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in back.collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert digest(table([])).count() == 0


def best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = min((k for k in range(len(bins)) if bins[k] >= x), key=lambda k: bins[k], default=None)
        if fit is None:
            bins.append(capacity - x)
        else:
            bins[fit] -= x
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_is_best_fit_decreasing(lengths):
    histogram = {x: lengths.count(x) for x in set(lengths)}
    p = plan(histogram, 20)
    key, runs = p.arrays()
    bins = {}
    for x, n in histogram.items():
        sequence, offset = p.place(key, runs, np.full(n, x), np.arange(n))
        for s, o in zip(sequence, offset, strict=True):
            bins.setdefault(int(s), []).append((int(o), x))
    for items in bins.values():
        at = 0
        for o, x in sorted(items):
            assert o == at
            at += x
    assert sorted(20 - sum(x for _, x in b) for b in bins.values()) == best_fit(lengths, 20)
    assert p.n_sequences == len(bins)


def test_tightest_fit():
    t = TightestFit(20)
    for room in (3, 8, 20):
        t.set(room, True)
    assert [t.at_least(x) for x in (1, 3, 4, 9, 20)] == [3, 3, 8, 20, 20]
    t.set(20, False)
    assert t.at_least(9) is None


def test_plan_does_not_grow_with_the_corpus():
    one = plan({x: 1 + x % 7 for x in range(1, 2049)})
    many = plan({x: 1_000_000 * (1 + x % 7) for x in range(1, 2049)})
    assert len(many.runs) < 4 * len(one.runs) + 2048 and len(many.runs) < 100_000


def test_packing_of_a_table(table, rows, library):
    got = pack(table(rows)).collect()
    lengths = []
    for (i, t), e in zip(rows, library.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True):
        ids = [*e.ids, 0]
        own = [r for r in got if r["doc_id"] == i]
        for k, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            lengths.append(len(part))
            assert any((r["piece"], r["start"], r["length"], r["ids_crc32"]) == (k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for r in own)
    assert sorted(r["length"] for r in got) == sorted(lengths)
    assert len({r["sequence_id"] for r in got}) == len(best_fit(lengths, 2048))
    assert pack(table([])).count() == 0

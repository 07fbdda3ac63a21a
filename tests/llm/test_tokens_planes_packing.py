from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickloom.llm import bitplanes, bm25_packing, token_ids
from tickloom.llm.common import TEXT_ROWS, file_system
from tickloom.llm.token_ids import encoder
from tickloom.session import scratch_path

WORD, BYTE = (public_tokenizers.path(f"{name}.json") for name in ("word_bpe_49k", "byte_bpe_50k"))


@lru_cache
def tokenizer(path: str, plain_names: bool = False) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = plain_names
    return found


def plain(path: str, text: str, plain_names: bool = False) -> list[int]:
    return tokenizer(path, plain_names).encode(text, add_special_tokens=False).ids


def by_pieces(path: str, spaces: str, texts: list[str | None], plain_names: bool = False) -> list[list[int]]:
    ids, bounds = encoder(path, spaces, plain_names).batch(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


@pytest.mark.parametrize("path, spaces", [(WORD, "dropped"), (BYTE, "joined")])
def test_pieces_give_the_ids_of_the_whole_text(path, spaces, odd_texts):
    texts = [text or "" for text in odd_texts]
    assert by_pieces(path, spaces, odd_texts) == [plain(path, text) for text in texts]


@pytest.mark.parametrize("plain_names", [False, True])
@pytest.mark.parametrize("path, spaces", [(WORD, "dropped"), (BYTE, "joined")])
def test_names_of_special_tokens(path, spaces, plain_names):
    names = [token.content for token in tokenizer(path).get_added_tokens_decoder().values()]
    texts = [text for name in names for text in (name, f"hello {name} world", f"x{name}.", f"a  {name}\n{name}b", name.upper())]
    got = by_pieces(path, spaces, texts, plain_names)
    assert got == [plain(path, text, plain_names) for text in texts] and names


@pytest.mark.parametrize("path, spaces", [(WORD, "dropped"), (BYTE, "joined")])
def test_runs_of_letters_go_to_the_model(path, spaces, monkeypatch):
    own = token_ids.Encoder(path, spaces)
    odd = ["ÀÉñ", "İstanbul", "ªµº", "ÿŸ", "straße", "e\u0301te", "Ωmega", "x²", "don't", "A'S", "½", "o'Neill's", "a\n", "\nb", "a\nb", "a.\nB,", "a\n\nb",
           "ends.\nThat", "a-b", "été.\nÉté", "a\r\nb", "a_b", "日本", "", "a.'s", "é\u0327", "ß\nß", "ÖÖ!?\nx", "…end", "a\u00a0b", "a\u0085b", "x×y", "LL\n'll"]
    rng = np.random.default_rng(3)
    letters = [*"abzAZéÖß", "İ", "ŉ", "'", ".", "\n", "1", "x", "s", "e", " "]
    texts = odd + [" ".join(odd), " ".join(reversed(odd))] + ["".join(rng.choice(letters, 12)) for _ in range(2000)]
    ids, bounds = own.batch(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [plain(path, text) for text in texts]
    asked = []
    monkeypatch.setattr(own, "direct", lambda pieces: asked.extend(pieces) or [b""] * len(pieces))
    own.batch(pa.array(["entirely newish, wördings\nand lines. (Cats) 12"]))
    assert not [piece for piece in asked if piece.strip().isalpha() or "\n" in piece]


def test_pieces_seen_again_stay_known(monkeypatch):
    monkeypatch.setattr(token_ids, "KEPT_PIECES", 20)
    own = token_ids.Encoder(WORD, "dropped")
    missed = []
    encoded = own._encoded
    monkeypatch.setattr(own, "_encoded", lambda pieces: missed.extend(pieces) or encoded(pieces))
    for k in range(30):
        own.batch(pa.array([f"often n{k}x"]))
        assert len(own.known) + len(own.older) <= 24
    assert missed.count("often") == 1


def test_known_pieces_are_forgotten_when_there_are_many(monkeypatch):
    monkeypatch.setattr(token_ids, "KEPT_PIECES", 6)
    monkeypatch.setattr(token_ids, "SLICE_BYTES", 20)
    texts = ["some words here.", "other words there, again", "some words here.", "", "again!! and (again)"]
    for path, spaces in ((WORD, "dropped"), (BYTE, "joined")):
        ids, bounds = token_ids.Encoder(path, spaces).batch(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [plain(path, text) for text in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abS' .,\n\t!é́🙂1<| ß", max_size=30), max_size=4))
def test_pieces_on_random_texts(texts):
    for path, spaces in ((WORD, "dropped"), (BYTE, "joined")):
        assert by_pieces(path, spaces, texts) == [plain(path, text) for text in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(ids, kind):
    row = np.array(ids, np.uint32)
    assert bitplanes.ids_of(bitplanes.planes_of(row, kind), len(ids), kind).tolist() == ids


@pytest.mark.parametrize("kind, block", [("bit", 64), ("byte", 1000), ("bit", 65_536)])
def test_files_give_back_all_ids(spark, make_docs, odd_texts, kind, block):
    docs = make_docs([(7 * k % 19, text) for k, text in enumerate(odd_texts)] + [(None, "no id"), (3, "again")])
    path = scratch_path(spark, "planes")
    bitplanes.write_ids(docs, path, BYTE, block_ids=block, kind=kind)
    rows = bitplanes.read_ids(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: -1 if i is None else i)
    want = sorted((-1 if i is None else i, plain(BYTE, t or "") + [0]) for i, t in docs.select("doc_id", "text").collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in rows) == want
    at = 0
    for row in rows:
        assert (row.start, row.n_tokens) == (at, len(row.ids))
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
        at += row.n_tokens


def test_chunk_index_reads_a_range(spark, make_docs):
    path = scratch_path(spark, "planes")
    bitplanes.write_ids(make_docs([(k, f"word{k} and more") for k in range(50)]), path, BYTE, block_ids=16)
    all_ids = [i for row in bitplanes.read_ids(spark, path).orderBy("start").collect() for i in row.ids]
    at = 0
    for row in spark.read.parquet(f"{path}/manifest").orderBy("part").collect():
        files, folder = file_system(path)
        with files.open_input_file(f"{folder}/data/{row.file}") as stream:
            reader = bitplanes.PlaneReader(stream)
            for lo, hi in ((0, 5), (15, 33), (16, 32), (0, row.n_ids), (row.n_ids - 1, row.n_ids)):
                assert reader.between(lo, hi).tolist() == all_ids[at + lo : at + min(hi, row.n_ids)]
        at += row.n_ids


def test_empty_tables(spark, make_docs):
    path = scratch_path(spark, "planes")
    docs = make_docs([(1, "x")]).where("doc_id > 1")
    bitplanes.write_ids(docs, path, BYTE)
    assert bitplanes.read_ids(spark, path).count() == 0
    assert bm25_packing.pack(docs, WORD).count() == 0


@pytest.mark.parametrize("window, shard", [(64, 300), (4096, 2_000_000), (16, 40)])
def test_packing_places_each_id_once(make_docs, odd_texts, window, shard):
    docs = make_docs([(k, text) for k, text in enumerate(odd_texts)] + [(None, "no id"), (3, "plain words here")])
    rows = bm25_packing.pack(docs, WORD, window=window, shard_tokens=shard).collect()
    again = bm25_packing.pack(docs.repartition(5), WORD, window=window, shard_tokens=shard).collect()
    assert sorted(rows, key=str) == sorted(again, key=str)
    sequences: dict[int, list] = {}
    for row in rows:
        assert len(row.ids) == row.length > 0
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
        sequences.setdefault(row.sequence_id, []).append(row)
    for pieces in sequences.values():
        at = 0
        for piece in sorted(pieces, key=lambda r: r.offset):
            assert piece.offset == at
            at += piece.length
        assert at == pieces[0].sequence_length <= window
        assert at & (at - 1) == 0  # a power of two: no padding at all
    unique = {r.doc_id: r.text for r in docs.collect() if r.doc_id != 3}
    for doc_id, text in unique.items():
        own = sorted((r.start, r.ids) for r in rows if r.doc_id == doc_id)
        assert [i for _, ids in own for i in ids] == plain(WORD, text or "") + [2]
    assert sum(r.length for r in rows) == sum(len(plain(WORD, r.text or "")) + 1 for r in docs.collect())


def test_neighbours_are_the_best_by_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 40, rng.integers(3, 30)) for _ in range(60)]
    counts, ids = np.array([len(d) for d in docs]), np.concatenate(docs)
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=40)
    rarity = np.log1p((60 - frequency + 0.5) / (frequency + 0.5))
    mean = counts.mean()
    index = bm25_packing.Index(ids, counts, rarity, mean)
    used = rng.random(60) < 0.3
    for seed in (0, 7, 59):
        scores = {}
        for k in np.flatnonzero(~used):
            total = 0.0
            for term in np.unique(docs[seed]):
                f = int((docs[k] == term).sum())
                total += rarity[term] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(docs[k]) / mean))
            scores[int(k)] = total
        ranked = index.ranked(seed, used).tolist()
        assert sorted(ranked) == sorted(scores)
        assert np.allclose([scores[k] for k in ranked], sorted(scores.values(), reverse=True))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70_000) | st.integers(0, 9), min_size=1, max_size=30), max_size=12))
def test_document_counts_of_ids_of_two_and_four_bytes(texts):
    rows = [np.array(text, "<u2" if max(text) < 1 << 16 else "<u4").tobytes() for text in texts]
    columns = [pa.array(range(len(texts)), pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(rows, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "ids"])
    (found,) = bm25_packing._document_counts(iter([batch]))
    want = {term: sum(term in text for text in texts) for text in texts for term in text}
    assert dict(zip(*(column.to_pylist() for column in found.columns))) == want


def test_packing_gets_whole_texts_a_few_at_a_time(spark, monkeypatch):
    """A batch of 10,000 whole texts would stand in the JVM and in Python, for every task."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)

    def batch_sizes(docs, *others):
        def sizes(batches):
            for batch in batches:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([n]), pa.array([b"\0\0" * n], pa.binary())], ["doc_id", "n", "ids"])

        return docs.mapInArrow(sizes, bm25_packing.ENCODED)

    monkeypatch.setattr(bm25_packing, "encoded", batch_sizes)
    found = bm25_packing.pack(spark.range(2 * TEXT_ROWS + 500).repartition(1), "").collect()
    assert sum(row.length for row in found) == 2 * TEXT_ROWS + 500
    assert max(row.doc_tokens for row in found) <= TEXT_ROWS and spark.conf.get(setting) == before

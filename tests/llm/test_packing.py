import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import token_encode
from tessella.llm.packing import BLOCK, PackedFile, PackedWriter, id_bits, pack, read_packed, token_output, unpack, write_packed
from tessella.llm.shared import workdir

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return token_encode.PieceEncoder(open(PATH).read())


PARTS = ["a.", "b,", " ", "  ", "\n", "\n\n", "\t", "é.", "×.", "Ã.", "don't", " 's", "1", "22", "!", "***", "<|endoftext|>", "日", "😀", "\x85", "\xa0", " ", " ", "　", "ç", "x", "Hello world", ". ", "_", "|>", "\x00", "\x7f"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PARTS), max_size=14).map("".join), st.text(max_size=20)), max_size=6))
def test_ids_are_those_of_whole_texts(encoder, texts):
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_forgetting(encoder, docs, monkeypatch):
    monkeypatch.setattr(token_encode, "REMEMBERED_BYTES", 5000)
    column = pa.array(docs.text.tolist()[:20])
    for _ in range(2):
        ids, at = encoder.encode(column[5:])
        assert ids[: at[1]].tolist() == encoder.tokenizer.encode(docs.text[5], add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.data())
def test_bits_round_trip(width, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << width) - 1), max_size=40)), np.uint32)
    packed = pack(ids, width)
    assert len(packed) == -(-len(ids) * width // 8) and unpack(packed, width, len(ids)).tolist() == ids.tolist()


def changed(**parts):
    import json

    return json.dumps(json.loads(open(PATH).read()) | parts)


def test_other_tokenizers_encode_whole_texts(docs):
    assert token_encode.cuts_apply(open(PATH).read())
    others = [
        changed(normalizer={"type": "Lowercase"}), changed(pre_tokenizer={"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}),
        changed(pre_tokenizer=None), changed(added_tokens=[{"id": 60000, "content": "a .b", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]),
    ]
    texts = ["Hello World. It is a .b test", *docs.text[:5]]
    for source in others:
        assert not token_encode.cuts_apply(source)
        made = token_encode.PieceEncoder(source)
        ids, at = made.encode(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == made.tokenizer.encode(text, add_special_tokens=False).ids
    assert token_encode.vocabulary_of(open(PATH).read()) == 50257


@pytest.mark.parametrize("text", ["日本語" * 20_000, "QUJD" * 30_000, "ab" * 50_000, " \n" * 30_000])
def test_long_texts_without_cuts(encoder, text):
    ids, _ = encoder.encode(pa.array([text, "x", text]))
    assert ids.tolist() == [y for t in (text, "x", text) for y in encoder.tokenizer.encode(t, add_special_tokens=False).ids]


class Counting:
    """A tokenizer that counts the texts that it encodes."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_words_go_through_the_library_together():
    encoder = token_encode.PieceEncoder(open(PATH).read())
    encoder.tokenizer = counting = Counting(encoder.tokenizer)
    texts = [" ".join(f"w{chr(97 + k % 26)}é{chr(97 + k // 26)}" for k in range(lo, lo + 60)) for lo in range(0, 600, 60)]
    ids, at = encoder.encode(pa.array(texts))
    assert counting.texts <= 20  # 600 words; the first of each text goes alone
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == counting.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from([*PARTS, " a", " é", " 日", " .", " <|endoftext|>", " 's", " \xa0x", " x\xa0", " Ã", " à"]), max_size=14).map("".join), max_size=6),
    st.integers(2, 24),
)
def test_joined_pieces_keep_their_ids(encoder, texts, size):
    encoder.forget()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(token_encode, "JOINED_BYTES", size)
        ids, at = encoder.encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_other_lengths_and_missing_bytes(docs):
    import json

    column = pa.array(docs.text.tolist()[:20])
    wrong = token_encode.PieceEncoder(open(PATH).read())
    wrong.lengths[wrong.tokenizer.token_to_id("e")] = 2
    model = json.loads(open(PATH).read())["model"]
    model["merges"] = [x for x in model["merges"] if not any("z" in y for y in x)]
    model["vocab"] = {x: k for x, k in model["vocab"].items() if "z" not in x}
    missing = token_encode.PieceEncoder(changed(model=model))
    assert missing.pieces and missing.lengths is None
    for encoder in (wrong, missing):
        ids, at = encoder.encode(column)
        for k, text in enumerate(column.to_pylist()):
            assert ids[at[k] : at[k + 1]].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_an_id_that_does_not_fit_raises(tmp_path):
    writer = PackedWriter(f"file://{tmp_path}/a.tpk", 8)
    with pytest.raises(ValueError):
        writer.add([1], np.array([1]), np.array([256], np.uint32))


def test_ids_shared_by_many_rows_are_spread(spark):
    rows = spark.createDataFrame([(None, f"text {k}") for k in range(2000)], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = write_packed(rows, PATH, workdir(spark, "packed-test")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) > 1 and sum(r.n_docs for r in files) == 2000


def test_fewest_bits():
    assert [id_bits(x) for x in (1, 2, 3, 256, 257, 50257, 65537)] == [1, 1, 2, 8, 9, 16, 17]


@pytest.mark.parametrize("width", [16, 17])
def test_random_access(tmp_path, width):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 1 << width, n).astype(np.uint32) for n in (0, 5, BLOCK, 3 * BLOCK + 7, 1)]
    writer = PackedWriter(f"file://{tmp_path}/a.tpk", width)
    writer.add([1, None], np.array([0, 5]), np.concatenate(docs[:2]))
    writer.add([7, 8, 9], np.array([len(x) for x in docs[2:]]), np.concatenate(docs[2:]))
    writer.close()
    packed = PackedFile(f"file://{tmp_path}/a.tpk")
    every = np.concatenate(docs)
    assert packed.doc_ids == [1, None, 7, 8, 9] and packed.total == len(every)
    for k, x in enumerate(docs):
        assert packed.document(k).tolist() == x.tolist()
    for lo, hi in ((0, 1), (BLOCK - 1, BLOCK + 1), (10, 10), (BLOCK * 2, BLOCK * 4), (-5, 10**9)):
        assert packed.ids(lo, hi).tolist() == every[max(lo, 0) : hi].tolist()


def mark(text):
    x = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def wanted(rows, encoder):
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, mark(r[1]), r[1] or "")):
        ids = [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_all_documents(spark, docs, encoder):
    found = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_output(spark.createDataFrame(docs).repartition(5), PATH).collect())
    assert found == wanted(list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)), encoder)


def test_edges(edge_docs, empty_docs, encoder):
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_output(edge_docs, PATH).collect())
    assert [(d, s, n, c) for s, d, n, c in found] == wanted([(r.doc_id, r.text) for r in edge_docs.collect()], encoder)
    assert token_output(empty_docs, PATH).count() == 0


def test_small_reads_give_the_same(spark, docs):
    from tessella.llm.packing import _read

    files = write_packed(spark.createDataFrame(docs), PATH, workdir(spark, "packed-test"))
    uris = [r.uri for r in files.orderBy("part").collect()]
    batch = pa.RecordBatch.from_pylist([{"uri": u, "base": 0} for u in uris])
    assert [x.to_pylist() for x in _read(100)([batch])] == [x.to_pylist() for x in _read()([batch])]
    assert read_packed(files).count() == len(docs)


def test_workers_forget_what_other_stages_keep(spark, docs):
    from tessella.llm.shared import tidied

    def kept(batches):
        for _ in batches:
            from tessella.llm import token_encode

            yield pa.RecordBatch.from_pylist([{"n": len(token_encode._encoders)}])

    one = spark.createDataFrame(docs[:20]).coalesce(1)
    for keeps, n in (("encoders", 1), ("", 0)):
        token_output(one, PATH).count()
        assert one.mapInArrow(tidied(kept, keeps), "n long").first().n <= n

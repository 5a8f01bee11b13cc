import glob

import pytest
import sentencepiece

from pairloom.llm import pieces

from . import cases

ODD = [
    "", " ", "  a  b ", "tab\tand\nline", "ﬁ ﬀ ½ Ⅷ ㌔ ｶﾞ", "é é", "　wide space", "😀😀 𝔘", "​﻿ zero", "a\u0000b",
    "▁under ▁ ▁▁x", "<s> </s> <unk>", "ا ل ع ر ب ي ة", "한글 각", "ཱི", "x" * 5000, "ab " * 3000, "� bad", "…—„“”",
]


def models():
    return sorted(glob.glob("/opt/tokenizers/*.model"))


@pytest.mark.parametrize("path", models(), ids=lambda p: p.rsplit("/", 1)[-1])
def test_same_as_library(spark, sf_dir, path):
    try:
        model = pieces.read_model(path)
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        encoder = pieces.Encoder(model)
    except (RuntimeError, ValueError) as e:
        pytest.skip(str(e)[:80])
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    for t in texts:
        ids, starts, ends = encoder.encode(t)
        assert ids.tolist() == library.encode(t, add_eos=True), t[:40]
        assert encoder.decode(ids.tolist()) == library.decode(library.encode(t, add_eos=True))
        size = len(t.encode())
        assert starts[-1] == ends[-1] == size
        assert all(0 <= a <= b <= size for a, b in zip(starts, ends, strict=True))
        assert (starts[1:] >= starts[:-1]).all() and (ends[1:] >= ends[:-1]).all()


def test_spans_name_their_pieces(spark):
    """Without spaces at the edges or a character map at work, a piece is the text of its span."""
    encoder = pieces.Encoder(pieces.read_model(pieces.tokenizer_path()))
    text = "The quick brown fox jumps over the lazy dog"
    ids, starts, ends = encoder.encode(text)
    for i, a, b in list(zip(ids.tolist(), starts, ends, strict=True))[:-1]:
        assert text.encode()[a:b].decode().strip() == encoder.library.id_to_piece(i).replace("▁", " ").strip()


def test_table(spark):
    model = pieces.read_model(pieces.tokenizer_path())
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    out = pieces.encode(cases.odd(spark), model, decoded=True).collect()
    want = {i: library.encode(t or "", add_eos=True) for i, t, *_ in cases.ODD}
    assert len(out) == len(cases.ODD)
    for r in out:
        assert r.ids == want[r.doc_id] and r.decoded == library.decode(want[r.doc_id])
    assert pieces.encode(cases.none(spark), model).collect() == []
    back = pieces.decode(pieces.encode(cases.odd(spark), model), model).collect()
    assert {r.doc_id: r.text for r in back} == {r.doc_id: r.decoded for r in out}


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map(rule):
    """The library's own compiled maps, put into a copy of the model: same ids, and spans that tile the text."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(pieces.read_model(pieces.tokenizer_path()))
    spec = sentencepiece_model_pb2.ModelProto()
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec.ParseFromString(normalizer.serialized_model_proto())
    assert len(spec.normalizer_spec.precompiled_charsmap) > 1000
    proto.normalizer_spec.precompiled_charsmap = spec.normalizer_spec.precompiled_charsmap
    for squeeze in (True, False):
        proto.normalizer_spec.remove_extra_whitespaces = squeeze
        model = proto.SerializeToString()
        encoder, library = pieces.Encoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)
        assert encoder.normalize.map.units and not encoder.normalize.plain
        for t in ODD:
            ids, starts, ends = encoder.encode(t)
            assert ids.tolist() == library.encode(t, add_eos=True), (rule, squeeze, t[:40])
            assert all(0 <= a <= b <= len(t.encode()) for a, b in zip(starts, ends, strict=True))
            assert (starts[1:] >= starts[:-1]).all()
    # a ligature is one character of three bytes whose replacement has two letters
    normal, origin = encoder.normalize("xﬁy".encode())
    at = normal.index(b"fi")
    assert origin[at] == origin[at + 1] == 1 and origin[at + 2] == 4

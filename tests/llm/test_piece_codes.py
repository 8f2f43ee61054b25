import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tipline.llm import piece_codes

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return piece_codes.load(PATH)


def check(model, library, texts: list[str], encoder=None) -> None:
    encoder, decoder = encoder or piece_codes.Encoder(model), piece_codes.Decoder(model)
    ids, bounds = encoder(pa.array(texts, pa.string()))
    want = library.encode(texts, num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want
    assert list(decoder(ids, bounds)) == [library.decode(w) for w in want]


ODD = ["", " ", "  ", "a", "▁", "▁▁a ▁", "a  b   c\t\td\n\n\n", "\x00", "<s></s><unk><0x41>", "日本語の文章です。", "é́ﬁⅣ", "🦆🦆q🏳️‍🌈", "x" * 3000, " " * 1001, "ab" * 1500, "=" * 77, "⁇ �", "1234567890", "ААААббб", "\n \n  \n", "https://a.b/c?d=e&f=%20"]


def test_odd_texts(model, library):
    check(model, library, ODD)


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=60, deadline=None)
def test_any_text(texts):
    model, library, encoder = _loaded()
    check(model, library, texts, encoder)


@given(st.lists(st.text(alphabet=st.sampled_from("aeinrst hlod\n ▁._-=0é日"), max_size=120), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_texts_of_few_letters(texts):
    model, library, encoder = _loaded()
    check(model, library, texts, encoder)


def _loaded(known: list = []):  # noqa: B006
    if not known:
        known += [piece_codes.load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)]
        known.append(piece_codes.Encoder(known[0]))
    return known


def test_long_texts_of_pieces(model, library):
    draw = random.Random(3)
    normal = [p.replace("▁", " ") for p, k in zip(model.pieces, model.kinds, strict=True) if k == piece_codes.NORMAL]
    check(model, library, ["".join(draw.choices(normal, k=n)) for n in (10, 100, 3000, 30_000)] + ["".join(draw.choices([p.strip() for p in normal], k=5000))])


def test_nothing_depends_on_what_a_task_remembers(model, library, monkeypatch):
    monkeypatch.setattr(piece_codes, "KNOWN_PARTS", 3)
    monkeypatch.setattr(piece_codes, "KNOWN_PAIRS", 3)
    check(model, library, ["the cat sat on the mat, thereupon that cat sat still", *ODD])


def test_decodes_any_ids(model, library):
    draw = random.Random(5)
    decoder = piece_codes.Decoder(model)
    some = [0, 1, 2, 28705, 264, 259, *range(3, 259)]
    lists = [[], [1], [28705], [1, 28705, 264], [3 + 0xE2, 3 + 0x96, 3 + 0x81, 264], *[draw.choices(some, k=draw.randint(1, 12)) for _ in range(2000)], *[draw.choices(range(32000), k=40) for _ in range(200)]]
    bounds = np.cumsum([0, *map(len, lists)])
    assert list(decoder(np.array([i for x in lists for i in x]), bounds)) == [library.decode(x) for x in lists]


def test_tables(spark, sf_dir, library, monkeypatch):
    monkeypatch.setattr(piece_codes, "SLICE_BYTES", 50_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "lang as ids", "source as text2")
    docs = docs.union(spark.createDataFrame([(None, None, "", ""), (None, "null id", "", ""), (5, "again", "", ""), (5, "again", "", ""), (6, "long " * 40_000, "", "")], docs.schema))
    rows = piece_codes.decode(piece_codes.encode(docs, PATH), PATH).collect()
    want = [(r.doc_id, library.encode(r.text or ""), r.text or "") for r in docs.collect()]
    assert sorted(((r.doc_id, list(r.ids), r.text) for r in rows), key=repr) == sorted(((i, ids, library.decode(ids)) for i, ids, _ in want), key=repr)
    assert piece_codes.encode(docs.limit(0), PATH).collect() == []
    odd = spark.createDataFrame([(1, None), (2, []), (3, [264, None, 264]), (None, [-1, 99_999_999])], "doc_id long, ids array<long>")
    got = {r.doc_id: (r.ids, r.text) for r in piece_codes.decode(odd, PATH).collect()}
    assert got == {1: ([], ""), 2: ([], ""), 3: ([264, 264], library.decode([264, 264])), None: ([-1, 99_999_999], library.decode([0, 0]))}


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    found = proto.ModelProto()
    with open(PATH, "rb") as f:
        found.ParseFromString(f.read())
    found.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(found.SerializeToString())
    with pytest.raises(ValueError, match="not a BPE model"):
        piece_codes.load(str(tmp_path / "m"))

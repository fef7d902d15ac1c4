import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, models

from strandgraph.llm import sentencepieces, token_counts

from .conftest import HARD, prose

ODD = list("  ▁ab\nc\t執é<0x41>thein​😀\x00 ")
PLAIN = list(" taeionrs,.")


@pytest.fixture(scope="module")
def model():
    return sentencepieces.read_model(None)


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


@pytest.fixture(scope="module")
def codec(model):
    return sentencepieces.Codec(model)


def random_texts(n):
    r = random.Random(5)
    return ["".join(r.choice(ODD if k % 2 else PLAIN) for _ in range(r.randint(0, 50))) for k in range(n)]


def test_ids_are_the_librarys(codec, library):
    for t in random_texts(4000) + [prose(k, 80) for k in range(50)] + ["a" * 3000, " " * 300 + "x", "ab" * 999 + "c", "▁▁ ▁ a", "\n\n\n", "x" * 20000]:
        assert codec.encode(t) == library.encode(t)


def test_decoding_is_the_librarys(codec, library):
    r = random.Random(6)
    for t in random_texts(1000):
        assert codec.decode(codec.encode(t)) == library.decode(library.encode(t))
    for _ in range(4000):
        ids = [r.choice([r.randrange(3), r.randrange(3, 259), r.randrange(32000)]) for _ in range(r.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_encoder_goes_back(codec):
    """There are texts whose longest pieces don't fit together."""
    longest_first = 0
    for t in ("▁" + w for k in range(40) for w in prose(k, 40).split()):
        taken, at = [], 0
        while at < len(t):
            size = max((n for n in range(1, len(t) - at + 1) if t[at : at + n] in codec.pieces.ids), default=1)
            taken.append(t[at : at + size])
            at += size
        longest_first += taken != [codec.pieces.surface[i] for i in codec.encode_chunk(t)]
    assert longest_first


def test_operator(documents, library):
    rows = sentencepieces.encode_decode(documents(HARD, extra=True), with_ids=True, with_text=True).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == sorted((i or 0, len(library.encode(t or ""))) for i, t in HARD)
    for r in rows:
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded == library.decode(list(r.ids)) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert sentencepieces.encode_decode(documents([])).collect() == []


def test_other_normalisation_is_refused():
    with pytest.raises(Exception):
        sentencepieces.Codec(b"not a model")


def test_counts_are_those_of_a_unigram_tokenizer(documents, model):
    counter = token_counts.Counter(model)
    other = Tokenizer(models.Unigram(counter.vocabulary, unk_id=counter.pieces.unknown, byte_fallback=True))
    count = lambda t: len(other.encode(counter.pieces.normalised(t)).ids)
    for t in random_texts(3000) + [prose(k, 50) for k in range(30)]:
        assert counter.count(t) == count(t)
    rows = token_counts.count_tokens(documents(HARD, extra=True)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == sorted((i or 0, count(t or "")) for i, t in HARD)
    assert token_counts.count_tokens(documents([])).collect() == []


def test_model_path_is_a_parameter(documents):
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert sentencepieces.encode_decode(documents([(1, "a b")]), model_path=path).first().n_tokens == 2

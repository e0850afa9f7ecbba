import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
import tiktoken

from quillmill.llm import bpe, tokencount


def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_round_trip_is_what_the_library_gives(spark, odd, texts):
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    want = Counter()
    for i, t in texts:
        ids = lib.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip(odd).collect())) == want


def test_every_vocabulary_string_encodes_as_itself():
    codec = bpe.Codec(ranks(), public_tokenizers.PATTERN)
    as_text = [b.decode("latin-1").translate(codec.to_characters) for b in codec.bytes_of]
    assert codec.model.encode(as_text) == [[i] for i in range(len(as_text))]


def test_token_ids(spark, odd):
    assert [r.ids for r in bpe.token_ids(odd.where("text = 'a'")).collect()] == [[ranks()[b"a"]]]


def test_counts_are_what_the_library_gives(spark, odd, texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((i, len(t.encode()), n, n > 4096) for i, t in texts for n in [len(lib.encode(t))])
    assert Counter(map(tuple, tokencount.token_counts(odd).collect())) == want


def test_counts_on_odd_strings():
    import random

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        counter = tokencount.Counter(f.read())
    rng = random.Random(1)
    some = ["".join(rng.choice(" \n\tabcthe ▁▁éß漢🙂'S\x00\r\xa0<s></s><unk>01") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert counter.count_batch(some) == [len(x) for x in lib.encode(some)]


def test_empty_tables(spark, none):
    assert bpe.round_trip(none).count() == 0 == tokencount.token_counts(none).count()

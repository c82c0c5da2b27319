import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm import bpe, media
from claimloom.llm.queries import tokenizer_path

from .helpers import AWKWARD, documents


def png_with(filters, samples):
    """A reference encoder: each row by the filter named, straight from the definitions."""
    h, w = samples.shape
    raw = bytearray()
    for y in range(h):
        raw.append(filters[y])
        for x in range(w):
            a, b = int(samples[y, x - 1]) if x else 0, int(samples[y - 1, x]) if y else 0
            c = int(samples[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            raw.append((int(samples[y, x]) - [0, a, b, (a + b) // 2, best][filters[y]]) % 256)
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return media.SIGNATURE + media.chunk(b"IHDR", head) + media.chunk(b"tEXt", b"k\0v") + media.chunk(b"IDAT", zlib.compress(bytes(raw))) + media.chunk(b"IEND", b"")


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.data())
def test_all_filters_are_undone(h, w, data):
    samples = np.array(data.draw(st.lists(st.integers(0, 255), min_size=h * w, max_size=h * w)), np.uint8).reshape(h, w)
    filters = data.draw(st.lists(st.integers(0, 4), min_size=h, max_size=h))
    assert (media.decode_png(png_with(filters, samples)) == samples).all()
    assert (media.decode_png(media.encode_png(samples)) == samples).all()


def test_damage_is_found():
    image = media.encode_png(np.arange(128, dtype=np.uint8).reshape(2, 64))
    for bad in (b"x" + image[1:], image[:20] + b"\xff" + image[21:], image[:-3], image[:-12]):
        with pytest.raises(ValueError):
            media.decode_png(bad)


def test_media_digest(spark):
    rows = media.media_digest(documents(spark, AWKWARD, ["media", "feature"])).collect()
    assert len(rows) == len(AWKWARD)
    want = {}
    for i, t in AWKWARD:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want[i] = (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id]
    same = [r for r in rows if r.doc_id in (4, 5)]
    assert len({(r.media_sha256, r.feature, r.media_bytes) for r in same}) == 1
    assert media.media_digest(documents(spark, [])).count() == 0


def test_the_hash_is_of_low_frequencies():
    import math

    rng = np.random.default_rng(5)
    for height in (1, 7, 32, 45, 200):
        x = rng.integers(0, 256, (height, 64)).astype(np.uint8)
        rows = [x[i * height // 32 : (i + 1) * height // 32].mean(0) if height >= 32 else x[i * height // 32].astype(float) for i in range(32)]
        grid = [[float(np.mean(r[2 * j : 2 * j + 2])) for j in range(32)] for r in rows]
        low = [[sum(grid[a][b] * math.cos(math.pi / 32 * (a + 0.5) * u) * math.cos(math.pi / 32 * (b + 0.5) * v) for a in range(32) for b in range(32)) for v in range(8)] for u in range(8)]
        flat = [round(f, 6) for r in low for f in r]
        middle = sorted(flat[1:])[31]
        bits = "".join("01"[k > 0 and f > middle] for k, f in enumerate(flat))
        assert media.cosine_hash(x) == f"{int(bits, 2):016x}"


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    library = Tokenizer.from_file(path)
    rows = bpe.token_digest(documents(spark, AWKWARD, ["ids", "n_tokens"]), path).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        text = next(t for i, t in AWKWARD if i == r.doc_id) or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.token_digest(documents(spark, []), path).count() == 0 and bpe.encode(documents(spark, [], ["decoded"]), path).columns[-1] == "ids"
    coded = bpe.decode(bpe.encode(documents(spark, AWKWARD[-1:]), path), path).first()
    assert coded.decoded == library.decode(list(coded.ids), skip_special_tokens=False)


def test_other_definitions_are_refused():
    import json

    with open(tokenizer_path(), "rb") as f:
        spec = json.load(f)
    for part, value in (("normalizer", None), ("decoder", {"type": "ByteLevel"}), ("pre_tokenizer", {"type": "Sequence", "pretokenizers": [{"type": "ByteLevel"}]})):
        with pytest.raises(ValueError, match="not supported"):
            bpe.BpeModel(json.dumps({**spec, part: value}).encode())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcAÉéΣσς ß'sdmrel\u0301\u00a0\n0129٣½中文한😀-_.,!<|", max_size=50))
def test_any_text_encodes_as_in_the_library(text):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    if not hasattr(test_any_text_encodes_as_in_the_library, "m"):
        with open(path, "rb") as f:
            test_any_text_encodes_as_in_the_library.m = bpe.BpeModel(f.read()), Tokenizer.from_file(path)
    own, library = test_any_text_encodes_as_in_the_library.m
    assert np.frombuffer(own.encode_batch([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids

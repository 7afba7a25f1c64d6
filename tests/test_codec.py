"""Values one at a time: round trips, corruption, and a seeded fuzzer in which validate must agree with
decode."""

import random

import pytest
import zstandard

from stowage.codec import FLOOR, KINDS, MAGIC, Codec, PackedError, Stored, dictionary_id

SAMPLES = [f"sample subject {i} ".encode() + str(hash(str(i)) % 10**9).encode() * 4 for i in range(1000)]
DICT = zstandard.train_dictionary(4096, SAMPLES).as_bytes()
ID = dictionary_id(DICT)
TEXT = b"sample subject 7 " * 40


def codec():
    return Codec({ID: DICT})


@pytest.mark.parametrize("data", [b"", b"x", b"x" * (FLOOR - 1), b"x" * FLOOR, TEXT, random.Random(1).randbytes(5000), "héllo 😀".encode() * 30, b"z" * 400_000])
@pytest.mark.parametrize("dict_id", [0, ID])
@pytest.mark.parametrize("level", [1, 6, 19])
def test_round_trip(data, dict_id, level):
    c = codec()
    v = c.encode(KINDS["bytes"], data, level, dict_id)
    assert c.decode(v, KINDS["bytes"]) == data and v.rawlen == len(data) and v.stored_bytes == len(v.payload)
    assert v.codec == (len(data) >= FLOOR and len(v.payload) < len(data))
    if v.codec:  # an independent reading of the frame
        frame = zstandard.get_frame_parameters(v.payload)
        assert (frame.content_size, frame.has_checksum, frame.dict_id) == (len(data), True, dict_id)


def test_dictionary_is_looked_up_even_for_tiny_values():
    with pytest.raises(PackedError, match="dictionary ID 5 is not available"):
        codec().encode(KINDS["text"], b"hi", 6, 5)


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"magic": 1}, "invalid or unsupported storage format"), ({"rawlen": 3}, "invalid frame header"), ({"format": 1}, "invalid value header"), ({"level": 0}, "invalid value header"), ({"level": 23}, "invalid value header"),
        ({"kind": 3}, "invalid value header"), ({"codec": 2}, "invalid value header"), ({"codec": 0}, "invalid raw value length"), ({"payload": b"abc"}, "invalid frame header"),
    ],
)
def test_corruption(change, message):
    c = codec()
    v = c.encode(KINDS["text"], TEXT, 6)._replace(**change)
    with pytest.raises(PackedError, match=message):
        c.decode(v, KINDS["text"])
    assert c.validate(v, KINDS["text"]) == message


def test_checksum_trailing_bytes_and_json_format():
    c = codec()
    v = c.encode(KINDS["text"], random.Random(2).randbytes(50).hex().encode() * 40, 6)
    broken = v._replace(payload=v.payload[:-1] + bytes([v.payload[-1] ^ 1]))
    with pytest.raises(PackedError):
        c.decode(broken, KINDS["text"])
    assert len(c.prefix(broken, 7)) == 7  # reads too little to meet the checksum
    with pytest.raises(PackedError):
        c.decode(v._replace(payload=v.payload + b"x"), KINDS["text"])
    j = c.encode(KINDS["json"], b'{"a": 1}', 6)
    assert c.validate(j._replace(format=2), KINDS["json"]) == "unsupported JSON payload format 2"
    assert "encoding UTF-8" in c.validate(c.encode(KINDS["bytes"], b"\xff", 6)._replace(kind=1), KINDS["text"])


def test_prefix_cuts_whole_characters():
    c = codec()
    for text in ("aä😀" * 300, "aä"):
        v = c.encode(KINDS["text"], text.encode(), 6)
        for n in (-1, 0, 1, 2, 3, 4, 5, 6, 7, 8, 500, 10**6):
            want = text.encode()[: max(n, 0)].decode(errors="ignore")
            assert c.prefix(v, n) == want


def test_decode_cache_and_dictionary_budget():
    c = codec()
    v = c.encode(KINDS["text"], TEXT, 6)
    for _ in range(3):
        c.decode(v, KINDS["text"])
    assert (c.counters.misses, c.counters.hits) == (1, 2)
    other = zstandard.train_dictionary(2048, [s[::-1] for s in SAMPLES]).as_bytes()
    small = Codec({ID: DICT, dictionary_id(other): other}, budget=1)
    for number in (ID, dictionary_id(other), ID):
        small.dictionary(number)
    assert small.counters.loads == 3 and small.counters.evictions == 2


def test_dictionary_bounds():
    for data in (b"", b"1234567", b"x" * 100, b"x" * ((1 << 20) + 1)):
        with pytest.raises(PackedError):
            dictionary_id(data)


@pytest.mark.parametrize("seed", range(3))
def test_fuzz_validate_agrees_with_decode(seed):
    c = codec()
    for i in range(400):
        draw = random.Random(f"{seed}:{i}")
        kind = draw.choice(list(KINDS.values()))
        data = draw.choice([b"", b'{"a": 1}', TEXT, b'["x", "%s"]' % TEXT, "é".encode() * 63, draw.randbytes(200) if kind == 3 else b"y" * 300_000])
        v = c.encode(kind, data, draw.choice([1, 6, 12]), draw.choice([0, ID]))
        for _ in range(draw.randint(0, 2)):
            field = draw.choice(Stored._fields)
            if field == "payload" and v.payload:
                raw = bytearray(v.payload)
                raw[draw.randrange(len(raw))] ^= 1 << draw.randrange(8)
                v = v._replace(payload=bytes(raw)[: draw.choice([len(raw), len(raw) - 1])])
            elif field != "payload":
                v = v._replace(**{field: draw.choice([0, 1, 2, 3, 23, 255, MAGIC, len(data) + 1])})
        try:
            got, problem = c.decode(v, kind, cached=False), None
        except PackedError as error:
            got, problem = None, str(error)
        assert c.validate(v, kind) == problem
        if problem is None and v.codec:
            assert got == data  # a frame that decodes is the value

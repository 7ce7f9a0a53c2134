import zlib

from loquat.operators import embed


def test_a_word_is_hashed_once(monkeypatch):
    """However often it comes, and the vector is that of all its places."""
    calls, plain = [], zlib.crc32
    monkeypatch.setattr(embed.zlib, "crc32", lambda b: calls.append(b) or plain(b))
    model = embed.hashing(64)
    one, three, mixed = model(["night", "night Night NIGHT", "night day"])
    assert len(calls) == (1 + len("night")) + (1 + len("day"))
    assert (one == three).all() and (one != mixed).any()
    assert not model([""]).any()

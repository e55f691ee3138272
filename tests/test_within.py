"""Parts of a file that can't hold what an operator wants are passed over, and nothing of what it wants is lost."""

import random

import pytest

from mediaframe.operators import boxes

OWNERS = ["1549A966", "AE", "B6", "61A7", "7373"]


def _made(rng: random.Random, depth: int = 0) -> bytes:
    out = b""
    for _ in range(rng.randrange(1, 5)):
        ident = bytes.fromhex(rng.choice([*OWNERS, "18538067", "1F43B675", "80", "A0", "4487", "85", "A3"]))
        body = _made(rng, depth + 1) if depth < 5 and rng.random() < 0.6 else rng.randbytes(rng.randrange(9))
        size = rng.choice([(len(body) | 0x4000).to_bytes(2, "big"), (len(body) | 1 << 28).to_bytes(4, "big"), b"\xff", b"\x01" + len(body).to_bytes(7, "big")]) if len(body) < 1 << 14 else (len(body) | 1 << 28).to_bytes(4, "big")
        out += ident + size + body
    return out


def _owned(data: bytes, owner: str, within: str | None) -> list[tuple]:
    above, out = {None: None}, []
    for node, parent, depth, name, at, size, _ in boxes._visit("ebml", data, 8, within):
        own = (name, at, size) if name == owner else above[parent]
        above[node] = own
        if own:
            out.append((own, depth, name, at, size))
    return out


@pytest.mark.parametrize("owner", OWNERS)
def test_nothing_within_an_owner_is_lost(owner):
    rng = random.Random(owner)
    found = 0
    for _ in range(300):
        data = _made(rng)
        data = data[: rng.randrange(len(data) + 1)] if rng.random() < 0.3 else data
        all_ = _owned(data, owner, None)
        assert _owned(data, owner, owner) == all_
        found += len(all_)
    assert found > 300


def test_parts_without_an_owner_are_not_entered():
    element = lambda ident, body: bytes.fromhex(ident) + (len(body) | 1 << 28).to_bytes(4, "big") + body
    blocks = element("1F43B675", element("A3", bytes(5)) * 100)
    tags = element("1254C367", element("7373", element("67C8", element("45A3", b"KEY"))))
    names = [x[3] for x in boxes._visit("ebml", element("18538067", blocks + tags), 8, "7373")]
    assert names == ["18538067", "1F43B675", "1254C367", "7373", "67C8", "45A3"]

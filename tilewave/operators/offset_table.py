"""The code of a picture's table of sample offsets, block by block in rows.

A block is "left" or "top", whose parameters it takes over, or its own (type, place, offsets): off, an edge class or the
first of four bands, with four offsets. Luma's parameters are followed by chroma's, which are off.
"""

from __future__ import annotations

from tilewave.operators.arithmetic_coder import Decoder, Encoder, get_signed, put_signed

OFF, EDGE, BAND = 0, 1, 2
MERGE, TYPE, CLASS, PLACE, OFFSET = range(5)
Block = str | tuple[int, int, tuple[int, ...]]


def _put_two(coder: Encoder, value: int, context: int) -> None:
    coder.put(value & 1, context)
    coder.put(value >> 1, context)


def _get_two(coder: Decoder, context: int) -> int:
    low = coder.get(context)
    return low | coder.get(context) << 1


def encode(blocks: list[Block], width: int) -> list[int]:
    coder = Encoder()
    for i, block in enumerate(blocks):
        if i % width:
            coder.put(int(block == "left"), MERGE)
        if i >= width and block != "left":
            coder.put(int(block == "top"), MERGE)
        if isinstance(block, str):
            continue
        kind, place, offsets = block
        _put_two(coder, kind, TYPE)
        if kind == EDGE:
            _put_two(coder, place, CLASS)
        elif kind == BAND:
            put_signed(coder, place, PLACE)
        if kind != OFF:
            for offset in offsets:
                put_signed(coder, offset, OFFSET)
        _put_two(coder, OFF, TYPE)
    return coder.finish()


def decode(code: list[int], n: int, width: int) -> list[Block]:
    coder, blocks = Decoder(code), []
    for i in range(n):
        if i % width and coder.get(MERGE):
            blocks.append("left")
            continue
        if i >= width and coder.get(MERGE):
            blocks.append("top")
            continue
        kind, place, offsets = _get_two(coder, TYPE), 0, ()
        if kind != OFF:
            place = _get_two(coder, CLASS) if kind == EDGE else get_signed(coder, PLACE)
            offsets = tuple(get_signed(coder, OFFSET) for _ in range(4))
        _get_two(coder, TYPE)
        blocks.append((kind, place, offsets))
    return blocks

"""The byte alphabet of byte-level BPE: printable bytes stand for themselves, the others for code points from 256 on."""

_plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
_rest = [b for b in range(256) if b not in _plain]
BYTE_SYMBOLS = {b: chr(b) for b in _plain} | {b: chr(256 + i) for i, b in enumerate(_rest)}

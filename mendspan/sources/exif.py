"""A small reader of EXIF tags in JPEG and TIFF data, for where no tag tool is installed. It never gives serial numbers."""

from __future__ import annotations

import struct

# Tag numbers of the EXIF standard.
MAKE, MODEL, DATE_TIME, EXIF_IFD = 0x010F, 0x0110, 0x0132, 0x8769
DATE_TIME_ORIGINAL, LENS_MODEL = 0x9003, 0xA434
NAMES = {MAKE: "Make", MODEL: "Model", DATE_TIME: "CreateDate", DATE_TIME_ORIGINAL: "DateTimeOriginal", LENS_MODEL: "LensModel"}


def _tiff_block(data: bytes) -> bytes | None:
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        if marker == 0xDA:
            return None
        at += 2 + size
    return None


def exif_tags(data: bytes) -> dict[str, str]:
    """ASCII tags by name; empty if there is no readable EXIF block."""
    block = _tiff_block(data)
    if block is None or len(block) < 8:
        return {}
    order = "<" if block[:2] == b"II" else ">"
    found: dict[str, str] = {}
    todo, seen = [struct.unpack(order + "I", block[4:8])[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(block):
            continue
        seen.add(at)
        for i in range(struct.unpack(order + "H", block[at : at + 2])[0]):
            entry = block[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(entry) < 12:
                break
            tag, kind, count, value = struct.unpack(order + "HHII", entry)
            if tag == EXIF_IFD:
                todo.append(value)
            elif tag in NAMES and kind == 2:
                text = entry[8 : 8 + count] if count <= 4 else block[value : value + count]
                found[NAMES[tag]] = text.split(b"\0")[0].decode("utf-8", "replace")
    return found

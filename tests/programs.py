"""Small executables with a version resource, built from the public format."""

import struct

from lokalith.sources.programs import FIXED_MARK


def block(file: tuple, product: tuple) -> bytes:
    numbers = struct.pack("<8H", *[x for a, b in ((file[0:2], file[2:4]), (product[0:2], product[2:4])) for pair in (a, b) for x in (pair[1], pair[0])])
    fixed = FIXED_MARK + struct.pack("<I", 0x10000) + numbers + bytes(28)
    name = "VS_VERSION_INFO\0".encode("utf-16-le")
    return struct.pack("<HHH", 6 + len(name) + 2 + len(fixed), len(fixed), 0) + name + b"\0\0" + fixed


def program(file=(5, 3, 2, 0), product=(5, 3, 2, 0), wide=True, versions=True, lead=300) -> bytes:
    """Headers, a section of ``lead`` bytes, and a resource section with icons and the version three levels deep."""
    version = block(file, product)
    entry = lambda name, at, folder: struct.pack("<II", name, at | (folder << 31))
    table = lambda *entries: struct.pack("<IIHHHH", 0, 0, 0, 0, 0, len(entries)) + b"".join(entries)
    rva = 0x3000
    kinds = [entry(3, 0x100, 1), *([entry(16, 0x40, 1)] if versions else [])]
    tree = table(*kinds).ljust(0x40, b"\0") + table(entry(1, 0x60, 1)).ljust(0x20, b"\0") + table(entry(1033, 0x80, 0)).ljust(0x20, b"\0")
    tree += struct.pack("<IIII", rva + 0x200, len(version), 0, 0)
    tree = tree.ljust(0x100, b"\0") + table(entry(1, 0x80, 0))
    tree = tree.ljust(0x200, b"\0") + version
    optional = struct.pack("<H", 0x20B if wide else 0x10B).ljust(112 if wide else 96, b"\0") + struct.pack("<4I", 0, 0, 0, 0) + struct.pack("<II", rva, len(tree)) + bytes(8 * 13)
    coff = struct.pack("<HHIIIHH", 0x8664, 2, 0, 0, 0, len(optional), 0)
    head = b"MZ".ljust(0x3C, b"\0") + struct.pack("<I", 0x80)
    head = head.ljust(0x80, b"\0") + b"PE\0\0" + coff + optional
    first, second = 0x400, 0x400 + lead
    section = lambda name, size, at, place: name.ljust(8, b"\0") + struct.pack("<4I", size, at, size, place) + bytes(16)
    head += section(b".text", lead, 0x1000, first) + section(b".rsrc", len(tree), rva, second)
    return head.ljust(first, b"\0") + bytes(lead) + tree

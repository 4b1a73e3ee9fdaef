"""Random texts with much to find, and things close to it."""

from __future__ import annotations

import random

PIECES = [
    "john.doe@example.com", "jane@company.co.uk", "a@b.c|d", "x@okaxis", "pay@upi.", "u_1@ybl", "@", ".@x.yz",
    "+91-9876543210", "09876543210", "+91 87654 32109", "+44 20 7946", "+1-555123", "919876543210", "9876543210",
    "1234 5678 9012", "123456789012", "987654321098", "4532-1234-5678-9012", "4111111111111111",
    "1234 5678 9012 3456", "٣٤٥٦ ٧٨٩٠ ١٢٣٤", "98765 43210",
    "ABCDE1234F", "abcde1234f", "xABCDE1234F", "192.168.1.100", "999.1.1.1", "10.0.0.50.7", "1.2.3.4é",
    "14 March 1992", "3 may 2001", "14/03/1992", "1992-03-14", "1-2-1992", "J1234567", "Z12345678",
    "123456789", "12345678901234567890", "HDFC0123456", "SBIN0abc", "android-ab12", "IOS-FF", "fp_hash_ab1", "FACE_TMP_9",
    "Address: 12 Long Lane Somewhere Nice", "addr:  short", "address : a, b", "ADDRESS:\n\nPlot Nine Sector Ten Block",
    "12 foo stand", "7 MG Road", "221 baker  street", "15 A B C avenue", "9 st", "3 \n rd", "Flat 3B Rose Villa",
    "house 9", "building X-1 and so on", "fl0wer power everywhere", "room 12 on the left", "unit é1 aaaaaa",
    "Mumbai 400001", "navi mumbai,  400701", "xPune, 411001", "delhi 11000", "Kota\n324001", "ſalem 636001",
    "phone", "email", "mobile", ".", ";", ",", "  ", "\n", "\t", " ", " ", "é", "😀", "ſt", "İ", "_", "-", "'", "\\", "''",
    "lorem ipsum dolor", "a", "12", "0", "\u001c", " ", "x" * 30, "1" * 25,
]


def random_texts(n: int, seed: int, longest: int = 14) -> list[str]:
    rng = random.Random(seed)
    joins = ["", " ", " ", " ", "\n", ", ", ". "]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, longest)):
            parts += [rng.choice(PIECES), rng.choice(joins)]
        texts.append("".join(parts))
    return texts


def long_text(seed: int, pieces: int) -> str:
    return random_texts(1, seed, 1)[0] + " ".join(random_texts(pieces, seed + 1, 4))

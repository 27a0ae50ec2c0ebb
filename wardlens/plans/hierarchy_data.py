"""A code hierarchy in the shape of the ICD-9-CM tree: root -> chapter -> block -> 3-digit code.

Fixed values: the chapter and block ranges of the public ICD-9-CM tabular list.
The 3-digit leaves are generated by rule (every code inside a block).  Codes in
no block (for example 028-029) get no leaf, so they fall in the gaps that the
interval operators must handle.  E and V supplementary chapters are left out.
"""

from __future__ import annotations

import json

# ICD-9-CM chapters (depth 1), in order, with titles.
CHAPTERS = [
    ("001-139", "Infectious and parasitic diseases"),
    ("140-239", "Neoplasms"),
    ("240-279", "Endocrine, nutritional and metabolic diseases, and immunity disorders"),
    ("280-289", "Diseases of the blood and blood-forming organs"),
    ("290-319", "Mental disorders"),
    ("320-389", "Diseases of the nervous system and sense organs"),
    ("390-459", "Diseases of the circulatory system"),
    ("460-519", "Diseases of the respiratory system"),
    ("520-579", "Diseases of the digestive system"),
    ("580-629", "Diseases of the genitourinary system"),
    ("630-679", "Complications of pregnancy, childbirth, and the puerperium"),
    ("680-709", "Diseases of the skin and subcutaneous tissue"),
    ("710-739", "Diseases of the musculoskeletal system and connective tissue"),
    ("740-759", "Congenital anomalies"),
    ("760-779", "Certain conditions originating in the perinatal period"),
    ("780-799", "Symptoms, signs, and ill-defined conditions"),
    ("800-999", "Injury and poisoning"),
]

# ICD-9-CM blocks (depth 2), in order.  Single-code blocks have no dash.
BLOCKS = (
    "001-009 010-018 020-027 030-041 042 045-049 050-057 060-066 070-079 080-088 090-099 100-104 "
    "110-118 120-129 130-136 137-139 140-149 150-159 160-165 170-176 179-189 190-199 200-208 209 "
    "210-229 230-234 235-238 239 240-246 249-259 260-269 270-279 280-289 290-294 295-299 300-316 "
    "317-319 320-327 330-337 338 339 340-349 350-359 360-379 380-389 390-392 393-398 401-405 "
    "410-414 415-417 420-429 430-438 440-449 451-459 460-466 470-478 480-488 490-496 500-508 "
    "510-519 520-529 530-539 540-543 550-553 555-558 560-569 570-579 580-589 590-599 600-608 "
    "610-612 614-616 617-629 630-639 640-649 650-659 660-669 670-677 678-679 680-686 690-698 "
    "700-709 710-719 720-724 725-729 730-739 740-759 760-763 764-779 780-789 790-796 797-799 "
    "800-804 805-809 810-819 820-829 830-839 840-848 850-854 860-869 870-879 880-887 890-897 "
    "900-904 905-909 910-919 920-924 925-929 930-939 940-949 950-957 958-959 960-979 980-989 "
    "990-995 996-999"
).split()


def _bounds(name: str) -> tuple[int, int]:
    lo, _, hi = name.partition("-")
    return int(lo), int(hi or lo)


def hierarchy_paths() -> list[list[dict]]:
    """Root-to-leaf paths, chapters in order; a path per 3-digit code inside a block."""
    paths = []
    root = {"depth": 0, "code": None, "descr": "ROOT"}
    for chapter, title in CHAPTERS:
        clo, chi = _bounds(chapter)
        ch = {"depth": 1, "code": chapter, "descr": title}
        for block in BLOCKS:
            blo, bhi = _bounds(block)
            if blo < clo or bhi > chi:
                continue
            bl = {"depth": 2, "code": block, "descr": f"Codes {block}"}
            for c in range(blo, bhi + 1):
                leaf = {"depth": 3, "code": f"{c:03d}", "descr": f"Code {c:03d} of {title.lower()}"}
                paths.append([root, ch, bl, leaf])
    return paths


def hierarchy_json() -> str:
    return json.dumps(hierarchy_paths())


def chapter_intervals() -> list[tuple[int, str, str]]:
    """(ord, start, end) strings of the depth-1 chapters, in tree order."""
    return [(i, n.split("-")[0], n.split("-")[1]) for i, (n, _) in enumerate(CHAPTERS)]

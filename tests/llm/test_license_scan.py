import pytest

from graphloom.llm import license_scan


@pytest.mark.parametrize("text,notice,k,edits", [
    ("all right reserved all rights reserved", "all rights reserved", 1, [1, 0]),
    ("mozila public license mozilla public license", "mozilla public license", 2, [1, 0]),
    ("all rights reserved all right reserved all rights reserved all rihts reserved", "all rights reserved", 1, [0, 1, 0, 1]),
    ("some rights", "all rights reserved", 1, []),
])
def test_adjacent_notices_with_edits_are_all_found(text, notice, k, edits):
    found = sorted(license_scan.fuzzy_matches(text, (("l", notice, k),)), key=lambda m: m[1])
    assert [m[3] for m in found] == edits
    assert all(a[2] <= b[1] for a, b in zip(found, found[1:]))

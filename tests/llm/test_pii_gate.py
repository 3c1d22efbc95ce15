import pytest

from quillgraph.llm import op7_pii as op7

SPELLINGS = ["jane [ at ] example.com", "jane <at> example.com", "jane ( at ) example [dot] com", "jane { AT } example.com", "jane at example.com", "jane\tat\nexample.com", "jane <@> example.com", "jane[at]example.com"]


@pytest.mark.parametrize("address", SPELLINGS)
def test_regions_hold_every_address_that_the_pattern_finds(address):
    text = f"Please write to {address} today"
    found = [m.span() for m in op7._MAIL_REGION.finditer(text)]
    assert found and all(any(a <= s and e <= b for a, b in op7.regions(text)) for s, e in found)
    assert op7.regions(f"{text}. An unrelated sign stands here: @") == op7.regions(text)


@pytest.mark.parametrize("way", range(8))
def test_disguised_addresses_are_searched(way):
    text = "Please write to " + op7.disguised("email", "jane@example.com", way)
    assert any(a <= 16 and b == len(text) for a, b in op7.regions(text))

"""No original of a detected entity is left: untitled mentions, plain phone numbers, IPv6 addresses."""

import re

from carespend.llm.pii import pseudonymise

CASES = [
    (1, "Mr John Smith came. Smith left. John Smith called; smith and Johnson stay, SMITH too."),
    (2, "Smith came first. Dr John Smith, then Mr John Smith and Prof Ada Lee."),
    (3, "Smith and John are in no name here, 10.2.33.254."),
    (None, "Mrs Smith, Smith"),
    (4, "call 555-123-4567, 555.123.4567 or 555 123 4567 not 1555-123-4567-8"),
    (5, "at 2001:db8::8a2e:370:7334 and 2001:DB8:0:0:1:2:3:4, fe80::1 or ::1; not 12:30:45, std::abc, a::b1c::d, Fcc::add"),
]


def test_no_original_is_left(spark):
    docs = spark.createDataFrame(CASES, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pseudonymise(docs, "key").collect()}
    one = re.fullmatch(r"Mr (\w+) (\w+) came\. (\w+) left\. (\w+) (\w+) called; smith and Johnson stay, (\w+) too\.", got[1]["text"])
    assert one and one[1] == one[4] and one[2] == one[3] == one[5] and one[6] == one[2].upper()
    assert "Smith" not in got[1]["text"] and not re.search(r"\bJohn\b", got[1]["text"]) and got[1]["n_entities"] == 5
    two = re.fullmatch(r"(\w+) came first\. Dr (\w+) (\w+), then Mr (\w+) (\w+) and Prof (\w+) (\w+)\.", got[2]["text"])
    assert two and two[1] == two[3] == two[5] == one[2] and two[2] == two[4] == one[1] and two[6].endswith("ri")
    assert got[3]["text"].startswith("Smith and John are")
    assert got[None]["text"] == f"Mrs {one[2]}, {one[2]}"
    four = re.fullmatch(r"call (\d{3})-(\d{3})-(\d{4}), (\d{3})\.(\d{3})\.(\d{4}) or (\d{3}) (\d{3}) (\d{4}) not 1555-123-4567-8", got[4]["text"])
    assert four and four.groups()[:3] == four.groups()[3:6] == four.groups()[6:] and "4567" not in four[0][:45] and got[4]["n_entities"] == 3
    five = got[5]["text"]
    assert got[5]["n_entities"] == 4 and five.endswith("; not 12:30:45, std::abc, a::b1c::d, Fcc::add")
    assert re.match(r"at [0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4} and [0-9a-f:]+, [0-9a-f]{4}::\d or ::\d;", five)
    assert not any(x in five.lower() for x in ("2001:db8", "fe80", " ::1;"))

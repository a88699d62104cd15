import json

import pytest

from kindred.plans.schema import MatchSchema, SchemaError

XML = r"""
<config>
  <idField pos="0"/>
  <databaseField pos="1"/>
  <exactField pos="2" name="country" match="DENY_DUP"/>
  <idxNGramField pos="3" name="summary"/>
  <nGramField pos="4" name="publisher" minScore="0.6"/>
  <exactField pos="5" name="volume" match="MAX_SCORE"/>
  <regExpField pos="6" name="code" pattern="([a-z]+)-" groupNum="1" requiredField="volume"/>
  <noCompField pos="7" name="shelf"/>
  <authorsField pos="8" name="people"/>
  <diceField pos="9" name="remarks" minScore="0.75"/>
  <score minValue="0.8" minFields="4"/>
  <score minValue="1" minFields="0"/>
  <score minValue="0.95" minFields="2"/>
</config>
"""


def test_round_trip_and_views():
    schema = MatchSchema.from_xml("s", XML)
    assert [f.name for f in schema.fields] == ["id", "database", "country", "summary", "publisher", "volume", "code", "shelf", "people", "remarks"]
    assert (schema.highest_tier, schema.lowest_tier) == (1.0, 0.8)
    assert MatchSchema.from_xml("s", schema.to_xml()) == schema
    shown = json.loads(schema.to_json())
    assert shown["total"] == 10 and shown["params"][9] == {"pos": 9, "name": "remarks", "type": "", "requiredField": "null", "contentMatch": "required"}
    assert shown["score"][0] == {"minValue": "1.0", "minFields": "0"}


@pytest.mark.parametrize(("old", "new"), [
    ('<databaseField pos="1"/>', ""), ('<idField pos="0"/>', '<idField pos="0"/><idField pos="0"/>'), ('pos="9"', 'pos="8"'), ('pos="9"', 'pos="10"'), ('match="DENY_DUP"', 'match="X"'),
    ('minScore="0.6"', 'minScore="1.6"'), ('minScore="0.6"', ""), ('groupNum="1"', 'groupNum="0"'), ('requiredField="volume"', 'requiredField="shelf"'),
    ('requiredField="volume"', 'requiredField="nosuch"'), ('minValue="0.95"', 'minValue="2"'), ('minFields="4"', 'minFields="-1"'), ("</config>", ""), ('pos="5"', 'pos="x"'),
])
def test_bad_schemas(old, new):
    with pytest.raises(SchemaError):
        MatchSchema.from_xml("s", XML.replace(old, new))


def test_equal_tiers_collapse_to_the_first():
    schema = MatchSchema.from_xml("s", XML.replace('minValue="0.95" minFields="2"', 'minValue="1" minFields="5"'))
    assert [(t.min_value, t.min_fields) for t in schema.tiers] == [(1.0, 0), (0.8, 4)]


def test_tiers_and_checked_fields_are_needed():
    with pytest.raises(SchemaError):
        MatchSchema.from_xml("s", '<config><databaseField pos="0"/><idField pos="1"/><idxNGramField pos="2" name="t"/><noCompField pos="3" name="n"/></config>')
    with pytest.raises(SchemaError):
        MatchSchema.from_xml("s", '<config><score minValue="1" minFields="0"/><databaseField pos="0"/><idField pos="1"/><idxNGramField pos="2" name="t"/></config>')

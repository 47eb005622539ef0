"""Our own lexicons: responses and urgency signals, as rows that can be extended or replaced."""

from __future__ import annotations

# category, tier, terms. A negative term holds a hit's words in another sense; a negation denies the need.
_RESPONSES = (
    ("SEARCH_AND_RESCUE", "strong", "trapped|buried under|stuck inside|rescue team|pulled from|people missing|swept away|stranded on the roof|locked in"),
    ("SEARCH_AND_RESCUE", "supporting", "stranded|collapsed|rubble|cut off|waiting on the roof|cannot get out"),
    ("SEARCH_AND_RESCUE", "negation", "no one trapped|nobody trapped|no one is trapped|everyone got out|all accounted for|no rescue needed"),
    ("SEARCH_AND_RESCUE", "negative", "trapped gas|trapped air|trapped heat|stuck in traffic"),
    ("MEDICAL_EMS", "strong", "injured|ambulance|not breathing|unconscious|bleeding|heart attack|broken leg|chest pain|needs a doctor|burned badly"),
    ("MEDICAL_EMS", "supporting", "hurt|wounded|fainted|in shock|vomiting|dizzy"),
    ("MEDICAL_EMS", "negation", "no injuries|no one injured|nobody injured|nobody hurt|no one hurt|no ambulance needed"),
    ("MEDICAL_EMS", "negative", "hurt feelings|injured pride"),
    ("FIRE_HAZMAT", "strong", "fire|in flames|burning building|gas leak|chemical spill|explosion|toxic fumes"),
    ("FIRE_HAZMAT", "supporting", "smoke|smell of gas|sparks|burning smell"),
    ("FIRE_HAZMAT", "negation", "no fire|fire is out|no smoke|false fire alarm"),
    ("FIRE_HAZMAT", "negative", "fire drill|fire station|fire sale|ceasefire line"),
    ("POLICE_SECURITY", "strong", "gunman|gunshots|armed man|hostage|riot|stabbing|looting"),
    ("POLICE_SECURITY", "supporting", "fight|crowd throwing|threatening|suspicious bag"),
    ("POLICE_SECURITY", "negation", "no weapons|no threat|nobody armed"),
    ("POLICE_SECURITY", "negative", "gunman statue|fight song"),
    ("PUBLIC_WORKS_UTILITY", "strong", "power line|burst pipe|water main|road blocked|bridge damaged|fallen tree"),
    ("PUBLIC_WORKS_UTILITY", "supporting", "outage|no power|no water|pothole|debris"),
    ("PUBLIC_WORKS_UTILITY", "negation", "power is back|road is clear|no damage"),
    ("ANY", "doubt", "maybe|possibly|might be|perhaps|not sure|someone said|unconfirmed|rumor|i think"),
)
# dimension, signal, base score, terms.
_URGENCY = (
    ("life", "TRAPPED", 85.0, "trapped|buried under|stuck inside|locked in"), ("life", "INJURED", 50.0, "injured|bleeding|hurt|wounded"),
    ("life", "UNCONSCIOUS", 80.0, "unconscious|not breathing"), ("life", "DROWNING", 85.0, "drowning|swept away"), ("life", "MISSING", 45.0, "missing"),
    ("velocity", "ACTIVE_FIRE", 70.0, "fire|in flames|explosion"), ("velocity", "ACTIVE_FLOODING", 65.0, "flood|flooded|water rising"),
    ("velocity", "COLLAPSE", 75.0, "collapsed|collapsing"), ("velocity", "GAS", 60.0, "gas leak|toxic fumes"),
    ("vulnerable", "CHILDREN_AT_RISK", 85.0, "children|child|baby"), ("vulnerable", "ELDERLY_AT_RISK", 80.0, "elderly|nursing home"), ("vulnerable", "PATIENTS_AT_RISK", 85.0, "patients|hospital ward"),
    ("negation", "TRAPPED", 0.0, "no one trapped|nobody trapped|no one is trapped|everyone got out"), ("negation", "INJURED", 0.0, "no injuries|no one injured|nobody injured|nobody hurt"),
    ("negation", "MISSING", 0.0, "no one missing|nobody missing|all accounted for"), ("negation", "ACTIVE_FIRE", 0.0, "no fire|fire is out|fire drill|fire station"),
    ("distress", "PLEA", 15.0, "please help|hurry"), ("distress", "SOS", 20.0, "sos|mayday"), ("temporal", "NOW", 15.0, "spreading|rapidly|right now|getting worse"),
    ("history", "HISTORICAL", 0.0, "last year|years ago|anniversary"), ("contained", "CONTAINED", 0.0, "under control|contained"),
    ("hedge", "HEDGE", 0.0, "might be|someone said|not sure|maybe"), ("novulnerable", "NONE", 0.0, "no children|no elderly"),
)


def response_rows() -> list[tuple[str, str, str]]:
    """``(class, tier, term)``."""
    return [(c, tier, t) for c, tier, ts in _RESPONSES for t in ts.split("|")]


def urgency_rows() -> list[tuple[str, str, float, str]]:
    """``(dim, signal, base, term)``."""
    return [(d, s, base, t) for d, s, base, ts in _URGENCY for t in ts.split("|")]

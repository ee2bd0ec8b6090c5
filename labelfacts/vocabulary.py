"""Word lists and constants of food labels."""

from __future__ import annotations

#: Term, French term, kind, and whether the label gives an amount only.
VOCABULARY = [
    (en, fr or en, kind, en in ("calories", "cholesterol", "protein"))
    for kind, pairs in (
        ("nutrient", "calories carbohydrate:glucides cholesterol fat:lipides fibre:fibres protein:proteines saturated:satures sodium sugars:sucres trans"),
        ("vitamin", "calcium iron:fer magnesium phosphorus:phosphore potassium vitamin_a:vitamine_a vitamin_c:vitamine_c vitamin_e:vitamine_e zinc"),
    )
    for en, _, fr in (p.replace("_", " ").partition(":") for p in pairs.split())
]
TERMS = [v[0] for v in VOCABULARY]
FRENCH = {v[0]: v[1] for v in VOCABULARY}
#: Short forms that some labels print.
SHORT = {"cholesterol": ["cholest"]}
#: Words whose halves a recogniser may have parted.
WHOLE = sorted({*FRENCH, *FRENCH.values()})
AMOUNT_ONLY = [v[0] for v in VOCABULARY if v[3]] + ["portion_size"]
UNITS = ["g", "mg", "ml", "ug"]
#: A label ends where one of these begins.
FOOTERS = sorted({"teneur de la", "teneur de le", "calories a day", "values may be higher", "daily values are based"} | {star + "amount in" + tail for star in ("", "*") for tail in ("", " cereal/dans")})
#: Terms of the other country's format; three of them that share a line with another reject a label.
FOREIGN = sorted(["zinc", "iron", "niacin", "folate", "thiamin", "calcium", "manganese", "magnesium", "phosphorus", "pantothenic"] + [f"vitamin {x}" for x in ("b 6", "d", "c", "a")])
ABSENT = "not a significant source"
NEW_FORMAT = ["5 % or less is a little 15 % or more is a lot", "5 % ou moins cest peu 15 % ou plus cest beaucoup"]
NEW_FORMAT_DISTANCE = 4
#: Words whose dictionary neighbours within distance 1 are dropped from an ingredient dictionary.
DISCARD = sorted(w.lower() for w in "Carbohydrates Glucides Valeur Lipides Fat Fibres fibers Fibre Sucres Sugars Proteines proteins Protein Potassium Sodium Iron Calcium".split()) + ["vitamin a", "vitamin c"]
LINE_FUDGE, SMALL_HEIGHT, OVERLAP = 2, 5, 0.10

"""Phenotype concepts: which (label, prompt) run feeds each concept, and the offline stand-in rule
the default rule model uses to answer that prompt.

The stand-in rules are the reference's own rule alternatives narrowed to what a prompt asks
(e.g. the percreta prompt answers with the percreta alternative of the accreta rule). Two prompts
have no rule in the reference (coagulopathy, low platelets); their stand-ins are marked below.
"""

from __future__ import annotations

from cohortlens.functions.rules import LABEL_RULES, SPAN_RULES

# ---------------------------------------------------------------------------
# Concept -> (label, prompt_desc) as the reference's phenotype scripts read them.
# ---------------------------------------------------------------------------
CONCEPT_RUNS = {
    'atony': ('uterine atony', 'disch_summary_curr_delivery_V2'),
    'methergine': ('methergine/methylergometrine', 'methergine_parenthesis_drug'),
    'hemabate': ('hemabate/carboprost', 'hemabate_parenthesis_drug'),
    'cytotec': ('cytotec/misoprostol - as uterotonic', 'after_delivery'),
    'uterine_rupture': ('Uterine rupture', 'rupture_of'),
    'laceration': ('laceration', 'disch_summary'),
    'PPH_surgical_extension': ('PPH - surgical causes', 'extension'),
    'PPH_surgical_damage_artery': ('PPH - surgical causes', 'cutting_artery'),
    'PPH_surgical_damage_ligament': ('PPH - surgical causes', 'damage_broad_ligament'),
    'dic': ('disseminated intravascular coagulation (DIC)', 'disch_summary_curr_delivery_V2'),
    'coagulopathy': ('disseminated intravascular coagulation (DIC)', 'coagulopathy'),
    'low_platelets': ('disseminated intravascular coagulation (DIC)', 'low_platelets'),
    'cryo': ('cryo', 'transfusion'),
    'ffp': ('ffp', 'transfusion'),
    'platelets': ('platelets', 'transfusion'),
    'oleary': ("O'Leary sutures", 'disch_summary_curr_delivery_V2'),
    'retained_poc': ('retained products of conception', 'only_retained_poc'),
    'd_and_c': ('dilation & curettage', 'curretage'),
    'manual_extraction': ('manual extraction of placenta', 'disch_summary'),
    'accreta': ('placenta accreta spectrum', 'disch_summary_curr_delivery_V2'),
    'percreta': ('placenta accreta spectrum', 'placenta_percreta'),
    'increta': ('placenta accreta spectrum', 'placenta_increta'),
    'csection': ('c-section', 'disch_summary_curr_delivery_V2'),
}

_SPAN = {label: pattern for label, pattern, _ in SPAN_RULES}

# Stand-in rules for prompts that narrow a label (alternatives of the reference's rules).
_NARROW = {
    'percreta': r'(?<!no )(placenta\s*percreta)',
    'increta': r'(?<!no )(placenta\s*increta)',
    'retained_poc': _SPAN['retained products of conception'],
    'd_and_c': _SPAN['dilation & curettage'],
    'PPH_surgical_extension': r'((?:uter|vagina).{0,10}extension|extension.{0,10}(?:uter|vagina))',
    'PPH_surgical_damage_artery': r'(artery.{0,10}lac|lac.{0,10}artery)',
    'PPH_surgical_damage_ligament': r'(ligament.{0,10}lac|lac.{0,10}ligament)',
    # no rule in the reference for these two prompts: plain keyword stand-ins
    'coagulopathy': r'(coagulopathy)',
    'low_platelets': r'(low platelets|thrombocytopenia)',
}

CONCEPT_RULES = {c: _NARROW.get(c, LABEL_RULES.get(label)) for c, (label, _) in CONCEPT_RUNS.items()}

# Composite concepts (C1-C4): (output concept, [(input concept, column suffix, must be present)], rule)
COMPOSITES = {
    'accreta_composite': ([('accreta', 'accreta', True), ('percreta', 'percreta', False),
                           ('increta', 'increta', False)], 'any'),
    'dic_composite': ([('dic', 'dic', True), ('coagulopathy', 'coagulopathy', False),
                       ('low_platelets', 'low_platelets', False)], 'any'),
    'surgical_composite': ([('PPH_surgical_extension', 'extension', True),
                            ('PPH_surgical_damage_artery', 'bleeding_artery', True),
                            ('PPH_surgical_damage_ligament', 'ligament_damage', False)], 'any'),
    'manual_composite': ([('manual_extraction', 'manual_extraction', True), ('csection', 'csection', False)],
                         'manual_without_csection'),
}

# The annotation label that each composite stands for.
COMPOSITE_GOLD = {
    'accreta_composite': 'placenta accreta spectrum',
    'dic_composite': 'disseminated intravascular coagulation (DIC)',
    'surgical_composite': 'PPH - surgical causes',
    'manual_composite': 'manual extraction of placenta',
}

# Subtype inputs (T1): pivot column suffix -> concept feeding it (composites for accreta and dic).
SUBTYPE_INPUTS = [
    ('atony', 'atony'), ('methergine', 'methergine'), ('cytotec', 'cytotec'), ('hemabate', 'hemabate'),
    ('accreta', 'accreta_composite'), ('retained_poc', 'retained_poc'), ('d_and_c', 'd_and_c'),
    ('manual_extraction', 'manual_extraction'), ('uterine_rupture', 'uterine_rupture'), ('dic', 'dic_composite'),
    ('cryo', 'cryo'), ('ffp', 'ffp'), ('platelets', 'platelets'), ('laceration', 'laceration'),
    ('oleary', 'oleary'), ('PPH_surgical_extension', 'PPH_surgical_extension'),
    ('PPH_surgical_damage_artery', 'PPH_surgical_damage_artery'),
    ('PPH_surgical_damage_ligament', 'PPH_surgical_damage_ligament'), ('csection', 'csection'),
]

"""Prompt catalogue (M1, M2): (label, prompt_desc) -> (prompt, prediction type).

Served to jobs as a small dimension (one row per catalogue entry, bounded by the catalogue
itself, so it can be broadcast). An unsupported pair raises, as in the reference.
"""

from __future__ import annotations

from cohortlens.functions.rules import BINARY_LABELS

# ---------------------------------------------------------------------------
# The reference's explicit prompts.
# ---------------------------------------------------------------------------
EXPLICIT_PROMPTS = {
    ('delivery_note', 'disch_summary'): "Answer the following yes/no question. Does this discharge summary note mention a woman's delivery?\n note: ",
    ('cryo', 'transfusion'): "Answer the following yes/no question. Does the following discharge summary mention transfusion of cryoprecipitate (cryo) during the current delivery? \n note: ",
    ('rbc', 'transfusion'): "Answer the following yes/no question. Does the following discharge summary mention transfusion of packed red blood cells (pRBCs) during the current delivery? \n note: ",
    ('platelets', 'transfusion'): "Answer the following yes/no question. Does the following discharge summary mention transfusion of platelets during the current delivery? \n note: ",
    ('ffp', 'transfusion'): "Answer the following yes/no question. Does the following discharge summary mention transfusion of frozen fresh plasma (ffp) during the current delivery? \n note: ",
    ('Uterine rupture', 'uterus_was'): "Answer the following yes/no question. Does the following discharge summary mention that the uterus was ruptured during the current delivery? \n note: ",
    ('Uterine rupture', 'rupture_of'): "Answer the following yes/no question. Does the following discharge summary mention rupture (dehiscence) of the uterus during the current delivery? \n note: ",
    ('PPH', 'disch_summary_curr_delivery'): "Answer the following yes/no question. Does this discharge summary note mention that the woman had postpartum hemorrhage (PPH) during her current delivery? \n note: ",
    ('PPH', 'disch_summary_curr_delivery_V2'): "Answer the following yes/no question. Does the following discharge summary mention postpartum hemorrhage (PPH) during the current delivery? \n note: ",
    ('PPH', 'disch_summary_curr_delivery_V3'): "Answer the following yes/no question. Does the following discharge summary mention postpartum hemorrhage (PPH) during the current delivery? \n discharge summary: ",
    ('PPH', 'disch_summary'): "Answer the following yes/no question. Does this discharge summary note mention that the woman had postpartum hemorrhage? \n note: ",
    ('PPH', 'disch_summary_v2'): "Answer the following yes/no question. Does the following discharge summary mention postpartum hemorrhage? \n note: ",
    ('PPH', 'disch_summary_v3'): "Answer the following yes/no question. Does the following discharge summary mention postpartum hemorrhage (PPH)? \n note: ",
    ('PPH - surgical causes', 'surgical_complication'): "Answer the following yes/no question. Does the following discharge summary mention a surgical complication during the current delivery? \n note: ",
    ('PPH - surgical causes', 'extension'): "Answer the following yes/no question. Does the following discharge summary mention extension of the uterine incision during the current delivery? \n note: ",
    ('PPH - surgical causes', 'cutting_artery'): "Answer the following yes/no question. Does the following discharge summary mention cutting of the uterine artery during the current delivery? \n note: ",
    ('PPH - surgical causes', 'damage_broad_ligament'): "Answer the following yes/no question. Does the following discharge summary mention damage to the broad ligament during the current delivery? \n note: ",
    ('placenta accreta spectrum', 'placenta_percreta'): "Answer the following yes/no question. Does the following discharge summary mention placenta percreta during the current delivery? \n note: ",
    ('placenta accreta spectrum', 'placenta_increta'): "Answer the following yes/no question. Does the following discharge summary mention placenta increta during the current delivery? \n note: ",
    ('retained products of conception', 'only_retained_poc'): "Answer the following yes/no question. Does the following discharge summary mention retained POCs (products of conception) during the current delivery? \n note: ",
    ('dilation & curettage', 'curretage'): "Answer the following yes/no question. Does the following discharge summary mention the procedure curretage (D&C) during the current delivery? \n note: ",
    ('disseminated intravascular coagulation (DIC)', 'coagulopathy'): "Answer the following yes/no question. Does the following discharge summary mention coagulopathy during the current delivery? \n note: ",
    ('disseminated intravascular coagulation (DIC)', 'low_platelets'): "Answer the following yes/no question. Does the following discharge summary mention low platelets during the current delivery? \n note: ",
    ('cytotec/misoprostol - as uterotonic', 'disch_summary_curr_delivery'): "Answer the following yes/no question. Does this discharge summary note mention that the woman was given cytotec (misoprostol) for atony during her current delivery? \n note: ",
    ('cytotec/misoprostol - as uterotonic', 'disch_summary_curr_delivery_V2'): "Answer the following yes/no question. Does the following discharge summary mention cytotec (misoprostol) for atony during the current delivery? \n note: ",
    ('cytotec/misoprostol - as uterotonic', 'disch_summary'): "Answer the following yes/no question. Does this discharge summary note mention that the woman was given cytotec (misoprostol) for atony? \n note: ",
    ('cytotec/misoprostol - as uterotonic', 'default'): "Answer the following yes/no question. Did the patient receive cytotec (misoprostol) for atony in the following note? \n note: ",
    ('cytotec/misoprostol - as uterotonic', 'disch_summary_V3'): "Answer the following yes/no question. Does the following discharge summary mention that the patient was given the drug Cytotec (Misoprostol) for atony? \n note: ",
    ('cytotec/misoprostol - as uterotonic', 'given_for_PPH'): "Answer the following yes/no question. Does the following discharge summary mention that the patient was given the drug Cytotec (Misoprostol) for pph? \n note: ",
    ('cytotec/misoprostol - as uterotonic', 'after_delivery'): "Answer the following yes/no question. Does the following discharge summary mention that the patient was given the drug Cytotec (Misoprostol) after the delivery? \n note: ",
    ('hemabate/carboprost', 'disch_summary_curr_delivery'): "Answer the following yes/no question. Does this discharge summary note mention that the woman was given hemabate or carboprost during her current delivery? \n note: ",
    ('hemabate/carboprost', 'disch_summary_curr_delivery_V2'): "Answer the following yes/no question. Does the following discharge summary mention hemabate or carboprost during the current delivery? \n note: ",
    ('hemabate/carboprost', 'disch_summary'): "Answer the following yes/no question. Does this discharge summary note mention that the woman was given hemabate or carboprost? \n note: ",
    ('hemabate/carboprost', 'default'): "Answer the following yes/no question. Did the patient receive hemabate or carboprost in the following note? \n note: ",
    ('hemabate/carboprost', 'hemabate_parenthesis_drug'): "Answer the following yes/no question. Does the following discharge summary mention the drug Hemabate (Carboprost)? \n note: ",
    ('methergine/methylergometrine', 'disch_summary_curr_delivery'): "Answer the following yes/no question. Does this discharge summary note mention that the woman was given methergine or methylergometrine during her current delivery? \n note: ",
    ('methergine/methylergometrine', 'disch_summary_curr_delivery_V2'): "Answer the following yes/no question. Does the following discharge summary mention methergine or methylergometrine during the current delivery? \n note: ",
    ('methergine/methylergometrine', 'disch_summary'): "Answer the following yes/no question. Does this discharge summary note mention that the woman was given methergine or methylergometrine? \n note: ",
    ('methergine/methylergometrine', 'default'): "Answer the following yes/no question. Did the patient receive methergine in the following note? \n note: ",
    ('methergine/methylergometrine', 'methergine_parenthesis_drug'): "Answer the following yes/no question. Does the following discharge summary mention the drug Methergine (Methylergometrine)? \n note: ",
    ('estimated blood loss', 'default'): 'Extract the estimated blood loss in the following note. If you can\'t find the answer, please respond "unanswerable".\n note:',
    ('estimated blood loss', 'disch_summary'): 'Extract the estimated blood loss in the following discharge summary. If you can\'t find the answer, please respond "unanswerable".\n note:',
    ('estimated blood loss', 'disch_summary_V2'): 'Extract the estimated blood loss (EBL) in the following discharge summary. If you can\'t find the answer, please respond "unanswerable".\n note:',
    ('estimated blood loss', 'disch_summary_current_delivery'): 'Extract the estimated blood loss (EBL) from the current delivery in the following discharge summary. If you can\'t find the answer, please respond "unanswerable".\n note:',
}
# Labels whose prompt does not depend on prompt_desc.
ANY_DESC_PROMPTS = {
    'transfusion amount': 'Extract the transfusion amount in the following note. If you can\'t find the answer, please respond "unanswerable".\n note:',
    'transfusion type': 'What is being transfused in the following note? If you can\'t find the answer, please respond "unanswerable".\n note:',
}
# Labels that only have explicit prompts (anything else for them is an error).
EXPLICIT_ONLY = {'delivery_note', 'PPH', 'cytotec/misoprostol - as uterotonic', 'hemabate/carboprost',
                 'methergine/methylergometrine', 'estimated blood loss'}
# ---------------------------------------------------------------------------
# Wording used in the generic binary templates.
# ---------------------------------------------------------------------------
PROMPT_LABELS = {
    'cryo': 'cryoprecipitate (cryo)', 'rbc': 'packed red blood cells', 'platelets': 'platelets',
    'ffp': 'fresh frozen plasma (FFP)', 'c-section': 'a cesarean section',
    'vaginal - spontaneous vertex': 'a spontaneous vertex vaginal delivery',
    'vaginal - forceps': 'a vaginal delivery with forceps', 'Bakri Balloon': 'a bakri balloon placement',
    'hysterectomy': 'a hysterectomy', 'Uterine rupture': 'uterine rupture', 'PPH': 'postpartum hemorrhage',
    'PPH - surgical causes': 'postpartum hemorrhage due to surgical causes', 'laceration': 'a laceration',
    'uterine atony': 'uterine atony', 'abruption of the placenta': 'an abruption of the placenta',
    'manual extraction of placenta': 'manual extraction of the placenta',
    'placenta accreta spectrum': 'placenta accreta', 'retained products of conception': 'retained products of conception',
    'dilation & curettage': 'a dilation and curettage', 'vaginal - vacuum extraction': 'a vaginal delivery with vaccum extraction',
    "O'Leary sutures": "O'Leary sutures", 'placenta previa': 'placenta previa',
    'disseminated intravascular coagulation (DIC)': 'disseminated intravascular coagulation (DIC)',
}
GENERIC_TEMPLATES = {
    'disch_summary': "Answer the following yes/no question. Does this discharge summary note mention that the woman had {}? \n note: ",
    'disch_summary_curr_delivery': "Answer the following yes/no question. Does this discharge summary note mention that the woman had {} during her current delivery? \n note: ",
    'default': "Answer the following yes/no question. Does the following note describe {}? \n note: ",
    'disch_summary_curr_delivery_V2': "Answer the following yes/no question. Does the following discharge summary mention {} during the current delivery? \n note: ",
}


def prediction_type(label: str) -> str:
    """M2."""
    return "binary" if label in BINARY_LABELS else "extraction"


def get_prompt(label: str, prompt_desc: str) -> tuple[str, str]:
    """M1: prompt text and prediction type for a (label, prompt_desc) pair."""
    if (label, prompt_desc) in EXPLICIT_PROMPTS:
        return EXPLICIT_PROMPTS[(label, prompt_desc)], prediction_type(label)
    if label in ANY_DESC_PROMPTS:
        return ANY_DESC_PROMPTS[label], prediction_type(label)
    if label in EXPLICIT_ONLY:
        raise ValueError(f"Missing Prompt for {label}")
    if label not in PROMPT_LABELS:
        raise NotImplementedError(label)
    if prediction_type(label) == "binary" and prompt_desc in GENERIC_TEMPLATES:
        return GENERIC_TEMPLATES[prompt_desc].format(PROMPT_LABELS[label]), "binary"
    raise ValueError(f"Missing Prompt for {label}")


def catalogue() -> list[tuple[str, str, str, str]]:
    """Every supported (label, prompt_desc, prompt, prediction_type) row."""
    rows = {(l, d): p for (l, d), p in EXPLICIT_PROMPTS.items()}
    for l in PROMPT_LABELS:
        if l in BINARY_LABELS and l not in EXPLICIT_ONLY:
            for d in GENERIC_TEMPLATES:
                rows.setdefault((l, d), get_prompt(l, d)[0])
    return [(l, d, p, prediction_type(l)) for (l, d), p in sorted(rows.items())]

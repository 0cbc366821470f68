"""The relation registry: names, identifiers and part-of-speech signatures."""

from __future__ import annotations

#: The active relations in identifier order, with the part of speech
#: of each argument.
SIGNATURES: dict[str, tuple[str, ...]] = {
    "subj_verb_dirobj": ("NN", "VB", "NN"),
    "subj_verb_indirobj": ("NN", "VB", "NN"),
    "subj_verb_instr": ("NN", "VB", "NN"),
    "subj_verb": ("NN", "VB"),
    "subj_verb_prep_compl": ("NN", "VB", "PREP", "NN"),
    "subj_verb_verb_prep_noun": ("NN", "VB", "VB", "PREP", "NN"),
    "subj_verb_verb": ("NN", "VB", "VB"),
    "noun_adj": ("NN", "ADJ"),
    "noun_verb_adv": ("NN", "VB", "RB"),
    "noun_equal_prep_noun": ("NN", "NN", "PREP", "NN"),
    "nn": ("NN", "NN"),
    "nnn": ("NN", "NN", "NN"),
    "noun_equal_noun": ("NN", "NN"),
    "noun_prep_noun": ("NN", "PREP", "NN"),
    "compl": ("ANY", "ANY"),
}

RELATIONS = tuple(SIGNATURES)

#: Parts of speech an argument may have.
PARTS_OF_SPEECH = ("NN", "VB", "ADJ", "RB", "PREP")

"""Prompt texts. Answers are only comparable when these stay word for word the same."""

NOTE = "<<NOTE>>"
EXAMPLES = "<<EXAMPLES>>"

_HEAD = """You are an expert political conflict event analyst.

Classify the following event into one of six categories: <<NOTE>>

Categories (use ONLY these single-letter codes):
- V = Violence against civilians
- B = Battles
- E = Explosions/Remote violence
- P = Protests
- R = Riots
- S = Strategic developments

"""

_TAIL = """CRITICAL: The "label" field must be exactly one of: V, B, E, P, R, S
Do not use numbers, full words, or any other values.

Additional requirements for `logits`:
- Each value in the `logits` object must be a decimal probability between 0 and 1.
- The six logits (V, B, E, P, R, S) must sum to 1.0.
"""

ZERO_SHOT = _HEAD + """Return ONLY valid JSON with this structure:
{
    "label": "<V, B, E, P, R, or S>",
    "confidence": <decimal between 0 and 1>,
    "logits": {"V": <num>, "B": <num>, "E": <num>, "P": <num>, "R": <num>, "S": <num>}
}

""" + _TAIL

EXPLAINABLE = _HEAD + """Step 1 — Brief structured reasoning (exactly three short items):
- Provide three-numbered, one-line observations only:
  1. Key actors (who)
  2. Key actions (what)
  3. Category rationale (why)
- Each observation must be at most 20 words.
- Do not include extra commentary or chain-of-thought beyond these three lines.

Step 2 — Final answer (valid JSON only):
Return ONLY valid JSON with this structure:
{
    "reasoning": [<three strings>],
    "label": "<V, B, E, P, R, or S>",
    "confidence": <decimal between 0 and 1>,
    "logits": {"V": <num>, "B": <num>, "E": <num>, "P": <num>, "R": <num>, "S": <num>}
}

""" + _TAIL

FEW_SHOT = """Examples:

    <<EXAMPLES>>
    --- Now classify the following event in the same format ---
    Final Answer: JSON matching the examples above.

        Return ONLY valid JSON with this structure:
        {
            "label": "<V, B, E, P, R, or S>",
            "confidence": <decimal between 0 and 1>,
            "logits": {
                "V": <num>, "B": <num>, "E": <num>, "P": <num>, "R": <num>, "S": <num>
            }
        }

        Additional requirements for `logits`:
        - Each value in the `logits` object must be a decimal probability between 0 and 1.
        - The six logits (V, B, E, P, R, S) must sum to 1.0.

    Event: <<NOTE>>
    """

EXPLAINABLE_SYSTEM = ("You are an expert political conflict event analyst. Always explain your reasoning step-by-step "
                      "before making classifications.")

FEW_SHOT_SYSTEM = """You are an expert political conflict event analyst. Classify events into one of six categories:
- V = Violence against civilians
- B = Battles
- E = Explosions/Remote violence
- P = Protests
- R = Riots
- S = Strategic developments

Return JSON with: label (V/B/E/P/R/S), confidence (0-1), and logits (probability for each category)."""

# Few-shot pool: five examples per label, each with its scores in the order V B E P R S.
# The label's own score is also the confidence.
POOL = {
    "V": [
        ("Military forces shot and injured a woman in Nongomadiba when they fired shots at a building they believed to be holding Ambazonian Separatists.", [0.89, 0.05, 0.02, 0.01, 0.02, 0.01]),
        ("Security forces opened fire on civilians during a raid in Bamenda, killing two people.", [0.94, 0.03, 0.01, 0.01, 0.01, 0.00]),
        ("Armed soldiers beat and detained three civilians suspected of supporting separatists in Kumbo.", [0.86, 0.02, 0.01, 0.02, 0.03, 0.06]),
        ("Police forces tortured detainees at a checkpoint in Buea, injuring five individuals.", [0.91, 0.03, 0.01, 0.01, 0.02, 0.02]),
        ("Military personnel looted civilian homes and assaulted residents in Mamfe.", [0.87, 0.02, 0.01, 0.02, 0.05, 0.03]),
    ],
    "B": [
        ("The police forces killed one suspected Boko Haram fighter and arrested another in Aissa Karde village.", [0.08, 0.82, 0.03, 0.01, 0.02, 0.04]),
        ("Military forces clashed with separatist fighters in Belo, resulting in casualties on both sides.", [0.03, 0.93, 0.02, 0.01, 0.01, 0.00]),
        ("Government troops engaged Boko Haram militants near Fotokol, killing several insurgents.", [0.04, 0.91, 0.03, 0.00, 0.01, 0.01]),
        ("Armed forces exchanged fire with rebel groups in the Northwest region for several hours.", [0.05, 0.89, 0.03, 0.01, 0.01, 0.01]),
        ("Security forces raided a separatist hideout in Kumba, killing three fighters.", [0.06, 0.85, 0.02, 0.01, 0.02, 0.04]),
    ],
    "E": [
        ("An IED planted by suspected Ambazonian separatists detonated in Matezen village, Santa subdivision, injuring three people.", [0.02, 0.01, 0.96, 0.00, 0.01, 0.00]),
        ("A roadside bomb exploded near a military convoy in Kolofata, wounding two soldiers.", [0.02, 0.02, 0.95, 0.00, 0.01, 0.00]),
        ("Unidentified militants launched a mortar attack on a police station in Mora.", [0.03, 0.03, 0.92, 0.00, 0.01, 0.01]),
        ("An explosive device detonated at a market in Maroua, killing one civilian and injuring ten.", [0.03, 0.01, 0.94, 0.01, 0.01, 0.00]),
        ("Suspected insurgents fired rockets at a military base in the Far North region.", [0.02, 0.03, 0.93, 0.00, 0.01, 0.01]),
    ],
    "P": [
        ("About a hundred residents demonstrated in Djoum town against the government's delay in compensating them after destroying their houses to build the Bikouna-Djoum road.", [0.02, 0.01, 0.01, 0.88, 0.06, 0.02]),
        ("Teachers held a peaceful protest in Yaoundé demanding better salaries and working conditions.", [0.01, 0.00, 0.00, 0.95, 0.03, 0.01]),
        ("Students marched through Douala to protest tuition fee increases at public universities.", [0.01, 0.01, 0.00, 0.93, 0.04, 0.01]),
        ("Civil society groups organized a demonstration in Bamenda calling for dialogue and peace.", [0.02, 0.01, 0.01, 0.91, 0.04, 0.01]),
        ("Healthcare workers staged a sit-in at the Ministry of Health demanding payment of arrears.", [0.01, 0.01, 0.00, 0.90, 0.05, 0.03]),
    ],
    "R": [
        ("Residents beat and killed 1 civilian from Ngouma in Tchika, accusing the victim of witchcraft.", [0.12, 0.03, 0.01, 0.03, 0.79, 0.02]),
        ("A mob attacked and burned shops owned by foreigners in Garoua following a dispute.", [0.08, 0.02, 0.02, 0.02, 0.84, 0.02]),
        ("Angry youths vandalized government buildings in Buea after a controversial election result.", [0.05, 0.02, 0.02, 0.08, 0.81, 0.02]),
        ("Residents clashed with police in Edéa, destroying vehicles and blocking roads.", [0.06, 0.04, 0.01, 0.04, 0.83, 0.02]),
        ("A violent crowd looted stores and set fire to a police post in Nkongsamba.", [0.09, 0.03, 0.02, 0.03, 0.80, 0.03]),
    ],
    "S": [
        ("Military forces arrested several civilians suspected of connection with ISWAP or Boko Haram militants in Djakana.", [0.10, 0.05, 0.02, 0.02, 0.04, 0.77]),
        ("Government troops increased patrols and established new checkpoints in the Anglophone regions.", [0.04, 0.03, 0.02, 0.02, 0.04, 0.85]),
        ("Security forces conducted a cordon-and-search operation in Mokolo, detaining suspected militants.", [0.07, 0.05, 0.02, 0.01, 0.04, 0.81]),
        ("The army deployed additional personnel to the Far North region to counter insurgent threats.", [0.05, 0.04, 0.03, 0.01, 0.04, 0.83]),
        ("Authorities imposed a curfew in several towns following reports of separatist activity.", [0.06, 0.04, 0.02, 0.03, 0.06, 0.79]),
    ],
}

# Wording of the training targets that carry a rationale.
LABEL_MEANING = {
    "V": "direct harm to civilians",
    "B": "armed clash between organized actors",
    "E": "explosive or remote attack",
    "P": "organized demonstration",
    "R": "violent crowd action",
    "S": "strategic operation without direct battle",
}
REASON_ACTORS = "Actors: inferred from event text snippet '{}'."
REASON_ACTIONS = "Actions: identify core conflict behavior and event dynamics."
REASON_LABEL = "Rationale: label {} best matches {}."
SNIPPET = 120

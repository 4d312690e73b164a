"""Regular expressions of the text annotators.

They must stay as they are for results to agree with published annotations.
All are written without look-around, so Java and RE2 read them alike.
"""

# Source provenance families.
STATE_MEDIA = [
    r"\bgovernment\s+(spokesman|official|source)",
    r"\bministry\s+of",
    r"\bstate\s+media",
    r"\bofficial\s+(statement|press|release)",
    r"\bpresidential",
    r"\bmilitary\s+(spokesman|source|official)",
    r"\barmy\s+(spokesman|source)",
    r"\bpolice\s+(spokesman|source)",
    r"\bCRTV\b",
    r"\bCameroon\s+Tribune\b",
    r"\bCameroon\s+News\s+Agency\b",
    r"\bNTA\b",
    r"\bFRCN\b",
    r"\bNews\s+Agency\s+of\s+Nigeria\b",
    r"\bNAN\b",
    r"\bAlgeria\s+Press\s+Service\b",
    r"\bAPS\b",
    r"\bXinhua\b",
    r"\bAnadolu\b",
]

INTERNATIONAL_MEDIA = [
    r"\bReuters\b",
    r"\bAFP\b",
    r"\bAP\b",
    r"\bAssociated\s+Press\b",
    r"\bBBC\b",
    r"\bVOA\b",
    r"\bRFI\b",
    r"\bAl\s+Jazeera\b",
    r"\bFrance\s+24\b",
    r"\bDW\b",
    r"\bThe\s+Guardian\b",
    r"\bNew\s+York\s+Times\b",
    r"\bWashington\s+Post\b",
    r"\bLe\s+Monde\b",
    r"\bInternational\s+Crisis\s+Group\b",
    r"\bICG\b",
    r"\bUNOCHA\b",
    r"\bUNHCR\b",
    r"\bAmnesty\s+International\b",
    r"\bHuman\s+Rights\s+Watch\b",
    r"\bHRW\b",
    r"\bCentre\s+for\s+Human\s+Rights\b",
]

NIGERIA_MEDIA = [
    r"\bDaily\s+Trust\b",
    r"\bDaily\s+Post\b",
    r"\bNigeria\s+Punch\b",
    r"\bPunch\b",
    r"\bSahara\s+Reporters\b",
    r"\bDaily\s+Independent\b",
    r"\bSun\s+\(Nigeria\)\b",
    r"\bVanguard\b",
    r"\bBlueprint\b",
    r"\bPremium\s+Times\b",
    r"\bDaily\s+Leadership\b",
    r"\bGuardian\s+\(Nigeria\)\b",
    r"\bHumAngle\b",
    r"\bNew\s+Telegraph\b",
    r"\bThe\s+Cable\b",
    r"\bDaily\s+Champion\b",
    r"\bCKN\s+Nigeria\b",
    r"\bInside\s+Arewa\b",
    r"\bEONS\s+Intelligence\b",
    r"\bCWC\s+\(Nigeria\)\b",
]

CAMEROON_MEDIA = [
    r"\bMimi\s+Mefo\b",
    r"\bSembe\s+TV\b",
    r"\bHumanity\s+Purpose\b",
    r"\bL'Oeil\b",
    r"\bCamer\.be\b",
    r"\bCameroon\s+Online\b",
    r"\bJournal\s+du\s+Cameroun\b",
    r"\bACTU\s+Cameroun\b",
]

NORTH_AFRICA_MEDIA = [
    r"\bEchorouk\b",
    r"\bAkher\s+Saa\b",
    r"\bEl\s+Khabar\b",
    r"\bEl\s+Watan\b",
    r"\bLe\s+Soir\s+d'Algerie\b",
    r"\bLe\s+Quotidien\s+d'Oran\b",
    r"\bDjazairess\b",
    r"\bL'Expression\b",
    r"\bEl\s+Massa\b",
    r"\bTSA\s+Algerie\b",
    r"\bEl\s+Djoumhouria\b",
    r"\bYabiladi\b",
    r"\bDjelfa\s+Info\b",
    r"\bLe360\b",
    r"\bMaghress\b",
    r"\bHespress\b",
    r"\bEnnahar\s+Online\b",
]

LOCAL_MEDIA = [
    r"\blocal\s+(media|source|journalist)",
    r"\bcommunity\s+source",
    r"\bwitness",
    r"\bresident",
    r"\bvillager",
    r"\bUndisclosed\s+Source\b",
    r"\bLocal\s+partner\b",
]

SOCIAL_MEDIA = [
    r"\bTwitter\b",
    r"\bFacebook\b",
    r"\bTelegram\b",
    r"\bWhatsApp\b",
    r"\bTikTok\b",
    r"\bInstagram\b",
    r"\bNew\s+media\b",
]

SECURITY_FIRMS = [
    r"\bRisk\s+and\s+Strategic\s+Management\b",
    r"\bRSM\b",
    r"\bControl\s+Risks\b",
    r"\bJanes\b",
    r"\bSITREP\b",
]

# Verb intensity; matched on lower-cased text.
HIGH_VERBS = [
    r"\bkill(ed|ing|s)?\b", r"\bmurder(ed|ing|s)?\b", r"\bslaughter(ed|ing|s)?\b",
    r"\bmassacre[ds]?\b", r"\bexecut(ed|ing|ion|es)?\b", r"\bassassinat(ed|ing|ion|es)?\b",
    r"\bbehead(ed|ing|s)?\b", r"\bbutcher(ed|ing|s)?\b", r"\bslain\b",
    r"\btortur(ed|ing|es?)?\b", r"\bmaim(ed|ing|s)?\b", r"\bmutilat(ed|ing|ion|es)?\b",
    r"\brape[ds]?\b", r"\bgang-?rape[ds]?\b",
    r"\bbomb(ed|ing|s)?\b", r"\bshell(ed|ing|s)?\b", r"\bblast(ed|ing|s)?\b",
    r"\bdetonat(ed|ing|ion|es)?\b", r"\bexplod(ed|ing|es)?\b",
    r"\braz(ed|ing|es)?\b", r"\bdestroy(ed|ing|s)?\b", r"\bannihilat(ed|ing|ion|es)?\b",
]

MEDIUM_VERBS = [
    r"\battack(ed|ing|s)?\b", r"\bshoot(ing|s)?\b", r"\bshot\b", r"\bfir(ed|ing|es)?\b",
    r"\bstrike[ds]?\b", r"\bstruck\b", r"\bambush(ed|ing|es)?\b",
    r"\bbeat(en|ing|s)?\b", r"\bassault(ed|ing|s)?\b", r"\bstab(bed|bing|s)?\b",
    r"\bwound(ed|ing|s)?\b", r"\binjur(ed|ing|y|ies)?\b",
    r"\bburn(ed|t|ing|s)?\b", r"\bloot(ed|ing|s)?\b", r"\bvandaliz(ed|ing|es)?\b",
    r"\braid(ed|ing|s)?\b",
    r"\babduct(ed|ing|ion|s)?\b", r"\bkidnap(ped|ping|s)?\b", r"\bseiz(ed|ing|es)?\b",
]

LOW_VERBS = [
    r"\bprotest(ed|ing|s)?\b", r"\bdemonstr(ated|ating|ation|ations)?\b",
    r"\brall(y|ied|ying|ies)\b", r"\bmarch(ed|ing|es)?\b",
    r"\bclash(ed|ing|es)?\b", r"\bconfront(ed|ing|ation|s)?\b",
    r"\bdispers(ed|ing|al|es)?\b", r"\bblock(ed|ing|ade|s)?\b",
    r"\bthreat(en|ened|ening|s)?\b", r"\bintimidat(ed|ing|ion|es)?\b",
    r"\bharass(ed|ing|ment|es)?\b", r"\bdetain(ed|ing|s)?\b", r"\barrest(ed|ing|s)?\b",
]

# Casualty mentions, tried in order on lower-cased text.
CASUALTIES = [
    r"\b(\d+)\s*(people|persons?|civilians?|soldiers?|militants?|fighters?|victims?)\s*(were\s+)?(killed|died|dead|slain)",
    r"\b(killed|dead|died|slain)\s*(\d+)",
    r"\bfatalit(y|ies)\b",
    r"\bdeath\s*toll\b",
    r"\bcasualt(y|ies)\b",
    r"\bbod(y|ies)\s*(found|recovered|discovered)",
    r"\b(dozens?|hundreds?|scores?)\s*(of\s+)?(people|civilians?|victims?)?\s*(killed|dead|died)",
    r"\bmass\s*(grave|killing|casualt)",
]

# Passive voice: each pattern counts once.
PASSIVE = [
    r"\bwas\s+\w+ed\b",
    r"\bwere\s+\w+ed\b",
    r"\bhas\s+been\s+\w+ed\b",
    r"\bhave\s+been\s+\w+ed\b",
    r"\bhad\s+been\s+\w+ed\b",
    r"\bbeing\s+\w+ed\b",
    r"\bbeen\s+\w+ed\b",
    r"\bwas\s+\w+en\b",
    r"\bwere\s+\w+en\b",
    r"\bhas\s+been\s+\w+en\b",
    r"\bhave\s+been\s+\w+en\b",
    r"\bwas\s+(shot|hit|cut|put|shut|hurt|set)\b",
    r"\bwere\s+(shot|hit|cut|put|shut|hurt|set)\b",
    r"\bwas\s+(killed|murdered|slain|executed|assassinated)\b",
    r"\bwere\s+(killed|murdered|slain|executed|assassinated)\b",
    r"\bwas\s+(attacked|ambushed|raided|assaulted|abducted)\b",
    r"\bwere\s+(attacked|ambushed|raided|assaulted|abducted)\b",
    r"\bwas\s+(burned|burnt|destroyed|looted|razed)\b",
    r"\bwere\s+(burned|burnt|destroyed|looted|razed)\b",
    r"\bwas\s+(injured|wounded|hurt|maimed)\b",
    r"\bwere\s+(injured|wounded|hurt|maimed)\b",
    r"\bwas\s+(kidnapped|captured|seized|detained|arrested)\b",
    r"\bwere\s+(kidnapped|captured|seized|detained|arrested)\b",
    r"\bwas\s+(bombed|shelled|fired\s+upon|shot\s+at)\b",
    r"\bwere\s+(bombed|shelled|fired\s+upon|shot\s+at)\b",
]

AGENT_OBSCURING = [
    r"\bby\s+unknown\s+(assailants?|gunmen|attackers?|perpetrators?|actors?|persons?|individuals?)",
    r"\bby\s+unidentified\s+(assailants?|gunmen|attackers?|perpetrators?|actors?|persons?|individuals?)",
    r"\bby\s+suspected\s+(militants?|gunmen|attackers?|terrorists?|criminals?)",
    r"\bby\s+armed\s+(men|persons?|individuals?|group)",
    r"\bby\s+unknown\s+persons?\b",
    r"\bby\s+gunmen\b",
    r"\bby\s+assailants?\b",
    r"\bby\s+attackers?\b",
]

PASSIVE_HEDGES = [
    r"\ballegedly\b",
    r"\breportedly\b",
    r"\bsuspected(ly)?\b",
    r"\bpurportedly\b",
    r"\bapparently\b",
    r"\bbelieved\s+to\s+(be|have)\b",
    r"\bthought\s+to\s+(be|have)\b",
    r"\bsaid\s+to\s+(be|have)\b",
    r"\bclaimed\s+to\b",
    r"\baccording\s+to\s+(reports?|sources?)\b",
]

NOMINALIZATIONS = [
    r"\bthe\s+(killing|murder|assassination|execution)\s+of\b",
    r"\bthe\s+(attack|raid|assault|ambush)\s+on\b",
    r"\bthe\s+(destruction|burning|looting)\s+of\b",
    r"\bthe\s+(abduction|kidnapping|capture)\s+of\b",
    r"\bthe\s+(bombing|shelling)\s+of\b",
    r"\bduring\s+(the\s+)?(attack|raid|assault|clash)",
    r"\bin\s+(the\s+)?(attack|raid|assault|incident)",
]

ACTIVE = [
    r"\b(military|army|police|soldiers|troops|forces)\s+(killed|attacked|shot|fired|bombed|raided|stormed|destroyed|arrested|detained|dispersed|opened\s+fire)",
    r"\b(militants?|fighters?|gunmen|attackers?|rebels?|insurgents?)\s+(killed|attacked|shot|fired|bombed|raided|stormed)",
    r"\b(group|gang|mob)\s+(killed|attacked|shot|assaulted)",
    r"\b[A-Z][a-z]+\s+(Forces|Army|Military|Police)\s+(killed|attacked|shot|arrested|detained)",
    r"\bBoko\s+Haram\s+(killed|attacked|bombed|raided)",
    r"\bISWAP\s+(killed|attacked|bombed|raided)",
    r"\bISIS\s+(killed|attacked|bombed)",
    r"\bAl[\s-]?(Qaeda|Shabaab)\s+(killed|attacked|bombed)",
    r"\b(they|he|she)\s+(killed|attacked|shot|fired|bombed)",
    r"\b(police|soldiers|troops|military|army)\s+(opened\s+fire|launched|conducted|carried\s+out)",
    r"\b(gunmen|attackers|militants)\s+(opened\s+fire|launched|carried\s+out)",
    r"\b\w+\s+(arrested|detained|seized|captured)\s+\d*\s*(suspects?|persons?|people|militants?|members?)",
]

# Ambiguous actor markers; matched on lower-cased text.
AMBIGUOUS_ACTOR = [
    r"\bunknown\s+(assailants?|gunmen|attackers?|perpetrators?|actors?|militants?)",
    r"\bunidentified\s+(assailants?|gunmen|attackers?|perpetrators?|actors?|militants?)",
    r"\bsuspected\s+(militants?|gunmen|attackers?|terrorists?)",
    r"\balleged(ly)?\s+(militants?|gunmen|attackers?)",
    r"\b(gunmen|attackers?|assailants?)\s+believed\s+to\s+be",
    r"\battribut(ed|ion)\s+to",
    r"\bclaimed\s+responsibility",
    r"\bno\s+(group|one)\s+(has\s+)?claimed",
    r"\bunclear\s+(who|which)",
    r"\b(disputed|conflicting)\s+(reports?|accounts?)",
]
AMBIGUOUS_ACTOR_TERMS = ["unknown", "unidentified", "suspected", "generic"]

# Boundary cues and hedges of the text part of the event ambiguity score.
BOUNDARY_CUES = [
    r"\bunknown\s+(assailants?|gunmen|attackers?|perpetrators?|actors?|militants?|armed\s+men)",
    r"\bunidentified\s+(assailants?|gunmen|attackers?|perpetrators?|actors?|militants?|armed\s+men)",
    r"\bsuspected\s+(militants?|gunmen|attackers?|terrorists?|jihadists?)",
    r"\balleged(ly)?\s+(militants?|gunmen|attackers?|terrorists?)",
    r"\b(armed\s+men|armed\s+group)\b",
    r"\bno\s+(group|one)\s+(has\s+)?claimed",
    r"\b(disputed|conflicting)\s+(reports?|accounts?)",
    r"\b(?:civilian\s+casualt|civilian\s+victim)",
    r"\b(?:killed\s+and\s+injur|injur\w+\s+and\s+kill)",
    r"\b(self-defense|self\s+defense|exchange\s+of\s+fire|crossfire)",
    r"\b(counter[- ]?attack|retali)",
]

SCORE_HEDGES = [
    r"\ballegedly?\b",
    r"\breportedly?\b",
    r"\bapparently?\b",
    r"\bseemingly\b",
    r"\bpossibly?\b",
    r"\bsupposedly?\b",
    r"\baccording\s+to\s+(?:unconfirmed|unverified)",
    r"\bcould\s+not\s+be\s+(confirmed|verified|independently)",
    r"\b(unconfirmed|unverified)\b",
]
SCORE_ACTOR_TERMS = ["unknown", "unidentified", "suspected", "generic", "armed group"]

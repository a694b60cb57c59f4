"""Rules that expand questions, in order: pattern (any case) and the words they add."""

from __future__ import annotations

import re
from itertools import product
from typing import NamedTuple

# Sections of the old codes and the words that stand for their successors.
IPC = (
    ("302", "BNS Section 103 murder"), ("304[Bb]", "BNS Section 80 dowry death"),
    ("304", "BNS Section 106 culpable homicide not amounting murder"), ("306", "BNS Section 108 abetment suicide"),
    ("307", "BNS Section 109 attempt to murder"), ("308", "BNS Section 110 attempt culpable homicide"),
    ("323", "BNS Section 115 voluntarily causing hurt"), ("354", "BNS Section 74 assault criminal force woman"),
    ("363", "BNS Section 137 kidnapping"), ("375", "BNS Section 63 rape definition consent"),
    ("376", "BNS Section 64 rape"), ("379", "BNS Section 303 theft"), ("392", "BNS Section 309 robbery"),
    ("395", "BNS Section 310 dacoity"), ("406", "BNS Section 316 criminal breach of trust"),
    ("409", "BNS Section 316 criminal breach of trust public servant"), ("420", "BNS Section 318 cheating"),
    ("427", "BNS Section 324 mischief"), ("447", "BNS Section 329 criminal trespass"),
    ("448", "BNS Section 330 house trespass"), ("498[Aa]", "BNS Section 85 cruelty husband wife"),
    ("499", "BNS Section 356 defamation"), ("500", "BNS Section 356 defamation punishment"),
    ("503", "BNS Section 351 criminal intimidation"), ("506", "BNS Section 351 criminal intimidation punishment"),
    ("124[Aa]", "BNS Section 152 sovereignty unity integrity India"),
    ("153[Aa]", "BNS Section 196 enmity groups religion"), ("120[Bb]", "BNS Section 61 criminal conspiracy"),
)
CRPC = (
    ("41", "BNSS Section 35 arrest without warrant police"), ("125", "BNSS Section 144 maintenance wife children parents"),
    ("144", "BNSS Section 163 order prevent unlawful assembly"), ("154", "BNSS Section 173 information cognizable offence FIR"),
    ("156", "BNSS Section 175 investigation cognizable offence"), ("161", "BNSS Section 180 examination witnesses police"),
    ("164", "BNSS Section 183 recording confession statement"), ("167", "BNSS Section 187 remand custody detention"),
    ("173", "BNSS Section 193 report police officer investigation charge sheet"),
    ("197", "BNSS Section 218 prosecution sanction public servant"),
    ("313", "BNSS Section 351 examination accused court statement"), ("320", "BNSS Section 359 compounding offences"),
    ("437", "BNSS Section 480 bail bailable offence"), ("438", "BNSS Section 482 anticipatory bail"),
    ("482", "BNSS Section 528 inherent powers High Court"),
)
# First information reports, before the plain abbreviation.
FIR = (
    (r"\bzero\s+FIR\b", "Section 173 BNSS information cognizable offence any police station"),
    (r"\be-?FIR\b", "Section 173 BNSS electronic communication information cognizable"),
)
# Numbers that need a word about a case; whether "accused of" and "under
# section" count.
CASES = (
    ("302", True, True, "BNS Section 103 murder"), ("307", False, True, "BNS Section 109 attempt to murder"),
    ("376", False, True, "BNS Section 64 rape"), ("420", False, True, "BNS Section 318 cheating"),
    ("498[Aa]", False, False, "BNS Section 85 cruelty husband wife"),
)
# Abbreviations; {1} stands for each number found.
ABBREVIATIONS = (
    (r"\bFIR\b", "First Information Report information cognizable offence police station"),
    (r"\bIPC\b", "Indian Penal Code"), (r"\bCrPC\b", "Code of Criminal Procedure"),
    (r"\bBNS\b", "Bharatiya Nyaya Sanhita"), (r"\bBNSS\b", "Bharatiya Nagarik Suraksha Sanhita"),
    (r"\bS\.?\s*(\d+)\b", "Section {1}"), (r"\b[Ss]ec\.?\s+(\d+)\b", "Section {1}"), (r"\bu\s*/\s*s\b", "under section"),
    (r"\b[Dd]hara\s+302\b", "BNS Section 103 murder IPC 302"), (r"\b[Dd]hara\s+304[Bb]\b", "BNS Section 80 dowry death IPC 304B"),
    (r"\b[Dd]hara\s+307\b", "BNS Section 109 attempt murder IPC 307"), (r"\b[Dd]hara\s+376\b", "BNS Section 64 rape IPC 376"),
    (r"\b[Dd]hara\s+420\b", "BNS Section 318 cheating IPC 420"),
    (r"\b[Dd]hara\s+498[Aa]\b", "BNS Section 85 cruelty husband wife IPC 498A"), (r"\b[Dd]hara\s+(\d+)\b", "Section {1}"),
)
# Words that the statutes don't use.
JARGON = (
    (r"\bcharge[\s-]?sheet\b", "Section 193 BNSS report police officer investigation"),
    (r"\bchallan\b", "Section 193 BNSS report police officer investigation"),
    (r"\bremand\b", "Section 187 BNSS custody detention investigation"),
    (r"\banticipatory\s+bail\b", "Section 482 BNSS anticipatory bail direction"),
    (r"\bdefault\s+bail\b", "Section 187 BNSS bail default sixty ninety days"),
    (r"\bmaintenance\b", "Section 144 BNSS maintenance wife children parents"),
    (r"\bsedition\b", "Section 152 BNS sovereignty unity integrity India acts endangering"),
    (r"\bsnatching\b", "Section 304 BNS snatching theft"),
    (r"\bcommunity\s+service\b", "Section 4 BNS punishment community service"),
    (r"\borganis[e]?d\s+crime\b", "Section 111 BNS organised crime syndicate"),
    (r"\borganiz[e]?d\s+crime\b", "Section 111 BNS organised crime syndicate"),
    (r"\bpetty\s+organis[e]?d\b", "Section 112 BNS petty organised crime pickpocket theft"),
    (r"\bterror(?:ism|ist)\b", "Section 113 BNS terrorist act"),
    (r"\bmob\s+lynching\b", "Section 103 BNS murder five or more persons"),
    (r"\bdowry\s+death\b", "Section 80 BNS dowry death"),
    (r"\bhit[\s-]and[\s-]run\b", "Section 106 BNS causing death rash negligent act escape"),
    (r"\bfalse\s+promise\s+to\s+marry\b", "Section 69 BNS sexual intercourse deceitful means promise marry"),
    (r"\bgang\s+rape\b", "Section 70 BNS gang rape"), (r"\brape\b", "Section 64 BNS punishment for rape sexual offence"),
    (r"\battempt\s+to\s+murder\b", "Section 109 BNS attempt to murder"),
    (r"\bmurder\b", "Section 103 BNS punishment for murder"),
    (r"\bkidnapping\b", "Section 137 BNS kidnapping from lawful guardianship"),
    (r"\btheft\b", "Section 303 BNS punishment for theft"), (r"\bcriminal\s+conspiracy\b", "Section 61 BNS criminal conspiracy"),
    (r"\bstalking\b", "Section 78 BNS stalking woman"), (r"\bvoyeurism\b", "Section 77 BNS voyeurism private act"),
    (r"\bacid\s+attack\b", "Section 124 BNS acid attack grievous hurt"),
    (r"\btrafficking\b", "Section 143 BNS trafficking person"),
    (r"\bpanchnama\b", "Section 194 BNSS police inquest report death seizure"),
    (r"\b(?:absconder|proclaimed\s+offender)\b", "Section 84 BNSS proclaimed offender absconding"),
    (r"\bcurfew\b", "Section 163 BNSS order prevent assembly"), (r"\bSection\s+144\b", "Section 163 BNSS order prevent assembly"),
    (r"\bthana\b", "police station officer in charge"), (r"\bchowki\b", "police station officer in charge"),
    (r"\bnon[\s-]cognizable\b", "non-cognizable offence complaint Magistrate police"),
)
# Numbers of the old penal code that a bare "section N" most likely means.
FAMOUS = {
    302: 103, 304: 106, 306: 108, 307: 109, 323: 115, 354: 74, 363: 137, 375: 63, 376: 64, 379: 303,
    392: 309, 395: 310, 406: 316, 420: 318, 447: 329, 498: 85, 499: 356, 503: 351, 506: 351,
}


def _code(code: str, number: str) -> str:
    """"IPC 302", "IPC Section 302", "302 of IPC", "Section 302 IPC": the code stands before
    the number or anywhere after it on the line."""
    return rf"\b{code}\s+(?:sec(?:tion)?\s+)?{number}\b|\b{number}\b[^\n]*\b{code}\b"


def _case(number: str, accused: bool, under: bool) -> str:
    ways = [rf"{number}\s+case", rf"(?:booked|charged)\s+(?:under\s+)?{number}"]
    ways += [rf"accused\s+(?:of\s+)?{number}"] * accused + [rf"u/?s\s*{number}"] + [rf"under\s+section\s+{number}"] * under
    return rf"\b(?:{'|'.join(ways)})\b"


def cases() -> tuple[tuple[str, str], ...]:
    return tuple((_case(n, a, u), words) for n, a, u, words in CASES)


#: All rules in order; the patterns hold no look-around, so other engines run them too.
RULES: tuple[tuple[str, str], ...] = (
    *FIR, *((_code("IPC", n), words) for n, words in IPC), *cases(),
    *((_code("CrPC", n), words) for n, words in CRPC), *ABBREVIATIONS, *JARGON,
)


class PhraseRule(NamedTuple):
    phrases: tuple[str, ...]
    words: str


#: What the parts of a pattern without numbers stand for, in folded text (one blank for a white
#: space, two for more).
_GAPS = {r"\b": ("",), r"\s+": (" ", "  "), r"\s*": ("", " ", "  "), r"[\s-]": (" ", "-")}
_PART = re.compile(r"\\b|\\s[+*]|\[\\s-\]|\[(?P<one>\w)\w?\]|\(\?:(?P<ways>(?:[^()]|\(\?:[^()]*\))*)\)|(?P<letter>[\w/-])")


def spelled(pattern: str) -> tuple[str, ...] | None:
    """All phrases that a pattern stands for, or None if they are not a few."""
    at, parts = 0, []
    while at < len(pattern):
        part = _PART.match(pattern, at)
        if part is None:
            return None
        at = part.end()
        if part["ways"] is not None:
            ways = [spelled(way) for way in _alternatives(part["ways"])]
            if None in ways:
                return None
            options = tuple(p for way in ways for p in way)
        else:
            options = _GAPS.get(part[0]) or ((part["one"] or part["letter"]).lower(),)
        if pattern.startswith("?", at):
            at, options = at + 1, ("", *options)
        parts.append(options)
    return tuple(dict.fromkeys("".join(p) for p in product(*parts)))


def _alternatives(ways: str) -> list[str]:
    """Cut at the bars that stand in no inner group."""
    out, depth = [""], 0
    for c in ways:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def groups() -> list[tuple[str, tuple]]:
    """The rules in order: runs of rules that are phrases, tables of numbers after a code, and
    patterns that add each number found."""
    out: list[tuple[str, tuple]] = []
    for block in (FIR, ("numbered", "IPC", IPC), cases(), ("numbered", "CrPC", CRPC), ABBREVIATIONS, JARGON):
        if block[0] == "numbered":
            out.append(("numbered", block[1:]))
            continue
        for pattern, words in block:
            known = None if "{1}" in words else spelled(pattern)
            if known is None:
                out.append(("each number", (pattern, words)))
            elif out and out[-1][0] == "phrases":
                out[-1] = ("phrases", (*out[-1][1], PhraseRule(known, words)))
            else:
                out.append(("phrases", (PhraseRule(known, words),)))
    return out


def phrase_rules() -> tuple[PhraseRule, ...]:
    return tuple(rule for kind, group in groups() if kind == "phrases" for rule in group)

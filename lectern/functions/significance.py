"""Which sentences are worth showing: procedure, courtesies, self-corrections and restatements are not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import col, stripped, word_count

# Patterns that decide what a sentence is.
CHAIR = r"(?i)^(?:the\s+)?(?:mr|mdm|madam|the)\s+(?:deputy\s+)?speaker\b|^\s*(?:mr|mdm|madam)\s+(?:deputy\s+)?speaker\s*$"
FLOOR = (
    r"(?i)\b(?:you have (?:a|the|one) \w+ to make|clarification to make|question to (?:ask|put)|(?:please |you may |may I ask you to )?(?:proceed|continue)\b"
    r"|i (?:now )?(?:call|invite)\b|(?:i (?:shall|will) now|the house will now|we will now)\b|(?:has|have) the (?:hon|honourable|member)\b"
    r"|no further (?:questions|supplementar)|(?:we|let us) (?:will )?move on|(?:your |the )time is up|speak(?:ing)?(?: to)?(?: the House)? ?later\b"
    r"|you (?:have|had) the floor|order[,.]?\s+order|(?:i will now|please) proceed\b)\b"
)
QUESTION_READ = (
    r"(?i)\b(?:the question is\b|question (?:put|proposed|agreed)|i (?:will now )?proceed to declare the voting results"
    r'|there are \d+[ ]*"?(?:ayes|noes|abstention)|(?:ayes|noes)"?, and no "?abstentions|not less than two-thirds of the (?:total number of )?members'
    r"|pursuant to article \d+\(\d+\)|(?:bill|motion|amendment) (?:be|is) (?:now )?(?:read|put) a (?:second|third) time|that the (?:bill|motion) be now (?:read|put)\b)\b"
)
CONSENT = (
    r"(?i)\bseek(?:s|ing)? (?:your|the)\b[^.]{0,40}\b(?:consent|assent)\b|\b(?:general )?assent of (?:hon )?members\b"
    r"|\bhave the general assent\b|\bi give my consent\b|\bpermission of the house\b"
)
RESTATEMENT = (
    r"(?i)^(?:i said\b|as i (?:have |had )?(?:said|mentioned|stated|noted)\b|as i did\b|i (?:have )?(?:mentioned|stated|noted)\b"
    r"|as (?:i )?(?:said|mentioned|stated) (?:earlier|later|above|before|just now)\b|to repeat\b|like i said\b|as mentioned\b|as (?:the|my) (?:hon|honourable) (?:member|friend)\b)"
)
COMMITMENT = (
    r"(?i)\b(?:will|shall|would|going to|intend|propose[sd]?|proposal|commit(?:s|ted|ment)?|plan(?:s|ned)?|target(?:s|ted)?|review(?:ing)?|consider(?:ing)?|introduc(?:e|ing)"
    r"|implement(?:ing)?|extend(?:ing)?|increas(?:e|ing)|reduc(?:e|ing)|from \d{4}\b|by \d{4}\b|effective\b|later this year|next year|in the coming)\b"
)
SUBSTANCE = (
    r"(?i)[$£]\d|\b\d[\d,.]*\s*(?:million|billion|per cent|percent|%|gigawatts?|days?|months?|years?|monthly|daily|a month|a year|per year)\b"
    r"|\b(?:last|this|next) (?:year|month|week|term)\b|\byesterday\b|\bBudget Statement\b|\bthe (?:Government|Ministry|Board|House) (?:will|expects|plans|intends)\b"
)
SELF_CORRECTION = (
    r"(?i)^\s*(?:yes,?\s+(?:speaker|mr speaker|mdm speaker)\.?\s*)?(?:i (?:misspoke|mis-spoke)\b|i (?:meant|mean) to say\b|what i (?:meant|mean)(?: to say)?\b"
    r"|i should have said\b|i (?:was|am) wrong\b|my mistake\b|i correct myself\b|to correct myself\b)"
)
CUES = (
    r"(?i)\bwill\b|\bfrom \d{4}\b|\bby \d{4}\b|\beffective\b|\bintroduce[ds]?\b|\bimplement|\ballocat|\bfund|\bcommitt|\bentitle|\beligib|\bsubsid|\bgrant"
    r"|\brelief\b|\bcap(?:ped)?\b|\bceiling\b|\bthreshold\b|\bper cent\b|\bpercent\b|[$£]\d|\b\d[\d,.]*\s*(?:million|billion|m|k)\b|\bwe (?:are|will|have|intend|plan)\b|\bthe (?:Ministry|Government|Board)\b"
)
MONEY = r"[$£]\d|\b\d[\d,.]*\s*(?:million|billion)\b"
PROMISE = r"(?i)\b(?:will|shall|commit|intend)\b"
NOISE = (
    r"(?i)^(?:thank|i thank|mr speaker|mdm speaker|madam speaker|mr deputy speaker|mdm|madam|sir|may i|i beg|with your permission|i am happy|i would like to|let me|firstly|secondly|finally|in conclusion)\b"
)
PROCEDURE = (
    r"(?i)^\W*\[?\(?\s*proc text\b|^(?:order (?:read|for)|question (?:put|proposed)|debate (?:resumed|adjourned)|sitting (?:suspended|resumed)|the house (?:adjourned|resumed)"
    r"|clerk (?:will|read)|leave of absence|papers? (?:laid|presented)|bill (?:read|introduced)|the house will now|i shall now put the question)\b"
    r"|\bseek(?:s|ing)? (?:your|the)\b[^.]{0,40}\b(?:consent|assent)\b|\b(?:general )?assent of (?:hon )?members\b|\bhave the general assent\b|\bi give my consent\b|\bpermission of the house\b"
    r"|^so,? just to confirm\b|^leader of the opposition,? you wanted\b|^(?:yes|no|sir|madam|correct|agreed|noted)\.?$"
)
#: Words of a sentence at least.
LEAST_WORDS = 8


def housekeeping(s: Column | str, speaker: Column | str) -> Column:
    """Whoever presides giving the floor, reading a question or asking for consent. Without a speaker the words decide."""
    tx, chair = stripped(s), F.coalesce(F.trim(col(speaker)).rlike(CHAIR), F.lit(True))
    return chair & (tx.rlike(FLOOR) | tx.rlike(QUESTION_READ) | tx.rlike(CONSENT))


def restates(s: Column | str) -> Column:
    """Whether a sentence opens by pointing back to what was said."""
    return stripped(s).rlike(RESTATEMENT)


def substantive(s: Column | str) -> Column:
    """Whether there is more in a sentence than its opener: a commitment, a figure, a horizon, who acts."""
    rest = F.regexp_replace(F.regexp_replace(stripped(s), RESTATEMENT, ""), "^[ ,:;-]+", "")
    return rest.rlike(COMMITMENT) | rest.rlike(SUBSTANCE)


def corrects_itself(s: Column | str) -> Column:
    return stripped(s).rlike(SELF_CORRECTION) & ~substantive(s)


def reason(s: Column | str, speaker: Column | str) -> Column:
    """Why a sentence by itself isn't significant, by an ordered ladder; null if it is."""
    bare = restates(s) & ~substantive(s)
    return F.when(housekeeping(s, speaker), "chair_housekeeping").when(corrects_itself(s), "self_correction").when(bare, "restatement")


def minimal_sentences(c: Column | str) -> Column:
    """A split at every end mark before a blank."""
    return F.filter(F.split(stripped(c), r"(?<=[.!?])\s+"), lambda x: x != "")


def screen(s: Column | str, speaker: Column | str) -> Column:
    """Why a sentence is not selected, the first reason that holds: too short, a courtesy, procedure, or not
    significant; null if it may be."""
    return F.when(word_count(s) < LEAST_WORDS, "too_short").when(col(s).rlike(NOISE), "courtesy").when(col(s).rlike(PROCEDURE), "procedural").otherwise(reason(s, speaker))


def salience(s: Column | str, position: Column | float = 0.0) -> Column:
    """Cues, money, promises, an early place (0 the first, 1 the last) and a middle length."""
    n = word_count(s)
    position = F.lit(position) if isinstance(position, float) else position
    return (
        2.0 * F.least(F.regexp_count(col(s), F.lit(CUES)), F.lit(4))
        + F.when(col(s).rlike(MONEY), 3.0).otherwise(0.0)
        + F.when(col(s).rlike(PROMISE), 2.5).otherwise(0.0)
        + 2.0 * (1.0 - position)
        + F.when(n.between(12, 40), 1.0).otherwise(0.0)
        - F.when(n > 50, 1.0).otherwise(0.0)
    )

"""Phrase lists and tests on transcript text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark announcements, greetings and roles.
IVR_PHRASES = [
    "thank you for calling", "please wait while", "your call may be recorded", "press 1", "press 2", "please hold",
    "home of the", "fixture-free guarantee",
]
IVR_SPEAKER_PHRASES = [
    "thank you for calling", "please wait while", "your call may be recorded", "press 1", "please hold", "home of the",
]
GREETINGS = ["hello.", "hi,", "hi.", "good afternoon", "good morning", "good evening"]
CUSTOMER_PHRASES = [
    "building office", "billing office", "billing department", "front desk", "reception",
    "i can take your information", "i can get your information", "forward it to my manager", "forward it over to",
    "i don't have his information", "i don't have access", "i will give this over to my manager", "i'll forward this",
    "i will get this forwarded",
]
AGENT_PHRASES = ["i'm with ", "i am with ", "i'm from ", "i am from ", "calling from ", "calling you from ", "this is "]
# Phrases that tell an agent or a customer.
ROLE_RULES = {
    "Agent": [
        "i'm with ", "i'm from ", "calling from ", "calling you from ", "looking to speak with", "trying to reach",
        "reaching out to you about", "calling regarding", "thanks for calling", "how can i help",
    ],
    "Customer": [
        "building office", "billing office", "front desk", "take your information", "what is this regarding",
        "is he helping you with something", "forward this to", "give this to my manager", "isn't working", "had issues with",
    ],
}
# Phrases of each fraud tactic.
FRAUD_LEXICON = {
    "impersonation": ["this is the irs", "from microsoft", "bank's fraud department", "police", "fbi", "dea", "government official", "tech support"],
    "urgency": ["act immediately", "within 24 hours", "deadline today", "right now"],
    "fear": ["legal action", "arrest warrant", "account frozen", "service disconnection"],
    "authority": ["final notice", "mandatory", "required by law", "official investigation"],
    "scarcity": ["limited time", "one-time offer", "last chance", "expires soon"],
    "payment": ["gift card", "wire the money", "wire transfer", "pay now", "send payment", "transfer funds", "bitcoin", "western union", "card number"],
    "sensitive_info": ["ssn", "social security", "password", "verification code", "mother's maiden name", "routing number", "date of birth"],
    "pressure": ["don't hang up", "don't tell anyone", "do it now"],
    "threats": ["hurt you", "physical harm", "ruin your reputation"],
}
# Own lists from here on.
SENTIMENT_LEXICON = {
    "very_positive": ["amazing", "fantastic", "excellent", "love", "wonderful"],
    "positive": ["thanks", "thank", "great", "good", "happy", "appreciate", "helpful"],
    "negative": ["bad", "problem", "issue", "unhappy", "disappointed", "frustrated", "upset", "wrong"],
    "very_negative": ["angry", "terrible", "horrible", "hate", "furious", "lawsuit", "worst"],
}
CALL_FLAGS = {
    "ivr": ["press 1", "press 2", "your call may be recorded", "please hold"],
    "voicemail": ["leave a message", "after the tone", "voicemail"],
    "callback_requested": ["call me back", "call back", "callback"],
    "wrong_number": ["wrong number"],
    "do_not_disturb": ["do not call", "stop calling", "don't call"],
    "agent_disclosed_recording": ["may be recorded", "is being recorded", "recorded line"],
}
PROHIBITED = ["stupid", "idiot", "shut up", "damn"]
OPENERS = ["hello", "hi", "good morning", "good afternoon", "good evening", "thank you for calling"]
CLOSERS = ["thank you", "have a great day", "have a good day", "goodbye", "bye"]


def pattern(phrases: list[str]) -> str:
    return "|".join(re.escape(p).replace("\\ ", " ").replace("\\-", "-") for p in phrases)


def mentions(text: Column, phrases: list[str]) -> Column:
    """Any phrase occurs in the text, ignoring case."""
    return F.coalesce(F.lower(text).rlike(pattern(phrases)), F.lit(False))


def word_mentions(text: Column, words: list[str]) -> Column:
    """Any phrase occurs on word borders."""
    return F.coalesce(F.lower(text).rlike(r"\b(" + pattern(words) + r")\b"), F.lit(False))


def looks_like_ivr(text: Column) -> Column:
    return mentions(text, IVR_PHRASES)


def starts_conversational(transcript: Column) -> Column:
    """The first line greets and does not sound like an announcement."""
    first = F.lower(F.split_part(F.trim(transcript), F.lit("\n"), F.lit(1)))
    return mentions(first, GREETINGS) & ~looks_like_ivr(first)


def speaker_labels(transcript: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(transcript, F.lit(r"\[(speaker_\d+)\]"), 1))


def matches_announcement(text: Column, announcement: Column) -> Column:
    """Contained either way, or at least 60 % of the smaller word set shared."""
    a, b = F.trim(F.lower(text)), F.trim(F.lower(announcement))
    wa, wb = F.array_distinct(F.split(a, r"\s+")), F.array_distinct(F.split(b, r"\s+"))
    share = F.size(F.array_intersect(wa, wb)) / F.least(F.size(wa), F.size(wb))
    return F.when((a == "") | (b == ""), False).otherwise(b.contains(a) | a.contains(b) | (share >= 0.6))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")

"""Word lists and constants that results depend on."""

from __future__ import annotations

# Domains and their keywords, in the order that breaks ties.
DOMAIN_KEYWORDS = {
    "physical": ["body", "sleep", "health", "fitness", "exercise", "pain", "energy", "doctor", "appointment", "medication", "therapy", "diagnosis", "symptom", "clinic", "hospital", "physical", "weight", "diet", "eating", "tired", "sick", "injury", "recovery", "surgery", "prescription", "checkup", "dr.", "dr ", "physician", "therapist"],
    "environmental": ["home", "room", "space", "environment", "apartment", "house", "rent", "lease", "move", "moving", "neighborhood", "city", "place", "office", "commute", "landlord", "furniture", "clean", "declutter"],
    "financial": ["money", "budget", "cash", "expense", "income", "tax", "finance", "salary", "savings", "spending", "pay", "bill", "debt", "loan", "invest", "investment", "afford", "cost", "price", "payment", "raise", "bonus", "account", "bank", "mortgage", "insurance"],
    "relational": ["friend", "partner", "family", "relationship", "dating", "marriage", "son", "daughter", "brother", "sister", "mom", "dad", "mother", "father", "wife", "husband", "boyfriend", "girlfriend", "fiance", "colleague", "coworker", "neighbor", "cousin", "uncle", "aunt", "grandma", "grandpa", "breakup", "divorce", "engaged", "wedding", "baby", "pregnant"],
    "work": ["work", "job", "project", "team", "meeting", "deadline", "client", "boss", "manager", "promotion", "fired", "hired", "resign", "quit", "interview", "offer", "onboard", "sprint", "launch", "product", "colleague", "performance", "review", "feedback", "career"],
    "status": ["status", "reputation", "credibility", "resume", "linkedin", "profile"],
    "appearance": ["appearance", "look", "style", "dress", "hair", "clothes", "outfit", "presentation"],
    "competence": ["competence", "skill", "capable", "ability", "performance", "learn", "practice", "improve"],
    "social_presence": ["social", "presence", "network", "community", "visibility", "post", "audience", "followers"],
    "desirability": ["desirable", "attractive", "desired", "romantic", "dating"],
}

# Keywords of sensitivity, in the order of the cascade.
SECRET_KEYWORDS = ["password", "credentials", "secret", "token", "private key", "api key", "ssh key", "auth"]
FINANCIAL_KEYWORDS = ["bank", "account", "tax", "salary", "invoice", "payment", "budget", "transaction", "credit card"]
LEGAL_KEYWORDS = ["legal", "lawyer", "attorney", "court", "divorce", "custody", "lawsuit", "contract"]
HEALTH_KEYWORDS = ["health", "medical", "diagnosis", "therapy", "doctor", "medication", "symptom"]
WORK_KEYWORDS = ["work", "project", "team", "manager", "client", "system", "infrastructure", "deployment", "release", "rollout"]

# Markers of facts and of claims.
FACT_MARKERS = [" asked ", " said ", " stated ", " noted ", " confirmed ", " scheduled ", " sent ", " updated ", " approved ", " rejected ", " met ", " requested ", " reported ", " attached "]
CLAIM_MARKERS = ["i think", "maybe", "might", "seems", "appears", "probably", "likely", "should", "need to", "always", "never", "feel", "feels", "worried", "hoping"]

# Patterns of injected instructions (case is ignored).
INJECTION_PATTERNS = [
    r"ignore\s+(previous|all|prior)\s+(instructions?|context|rules?|system)",
    r"(new|updated?)\s+(system\s+)?prompt[:\s]",
    r"(disregard|forget|override)\s+(everything|all\s+instructions?|system|previous)",
    r"act\s+as\s+(if\s+you\s+are\s+)?a?\s*(different|new|unrestricted)",
    r"you\s+are\s+now\s+a",
    r"</?(system|instruction|context|prompt)\s*/?>",
    r"\[INST\]|\[/INST\]|\[SYS\]",
    r"<\|im_start\|>|<\|im_end\|>",
]

# Codes of reasoning errors and the phrases that show them.
REASONING_ERRORS = {
    "mind_reading": ["mind reading", "you are thinking", "they are thinking", "he was trying to"],
    "catastrophizing": ["disaster", "ruined", "destroyed", "worst case", "everything will fall apart"],
    "emotional_reasoning": ["i feel like", "feels like therefore", "because it feels", "therefore it's true"],
    "overgeneralization": ["always", "never", "everyone", "no one", "every time"],
    "personalization": ["because of me", "my fault", "they targeted me"],
    "discounting_positives": ["doesn't count", "just lucky", "nothing good", "ignore the good"],
    "all_or_nothing_thinking": ["either", "totally", "completely", "100%", "all or nothing"],
    "should_statements": ["should have", "shouldn't have", "must have"],
    "confirmation_bias": ["obviously", "as expected", "proves my point"],
    "insufficient_alternative_hypotheses": ["only explanation", "the only reason", "must be because"],
    "post_hoc": ["after that, so because", "therefore caused"],
    "motte_and_bailey": ["motte", "bailey"],
    "equivocation": ["means the same", "same thing", "therefore"],
    "hasty_generalization": ["always", "never", "this proves"],
    "false_dichotomy": ["either/or", "only two choices"],
    "slippery_slope": ["if this happens then everything"],
    "ad_hominem": ["because they are", "they're a"],
    "appeal_to_authority": ["expert says", "because authority"],
    "circular_reasoning": ["because it is true", "it is true because"],
    "base_rate_neglect": ["unique", "special case", "won't happen here"],
    "availability_bias": ["recently", "memorable", "stands out"],
    "survivorship_bias": ["success stories", "winners", "only the people who"],
    "sunk_cost_fallacy": ["already invested", "can't stop now"],
    "loss_aversion": ["can't lose", "afraid of losing"],
    "status_quo_bias": ["keep things as they are", "don't change"],
    "incentive_misread": ["must be trying to", "their incentive is"],
}

# Phrase banks of the salience score.
DECISION_PHRASES = ["i decided", "i've decided", "we decided", "i'm going to", "we're going to", "going forward", "from now on", "made a decision", "decided to", "i will", "we will", "the plan is", "i plan to", "we plan to"]
OPEN_LOOP_PHRASES = ["i need to", "i should", "remind me to", "i have to", "don't let me forget", "i want to remember", "need to follow up", "need to check", "follow up on", "i must", "we need to", "we should"]
DURABLE_PLAN_PHRASES = ["plan for", "template for", "checklist", "how should i", "what's the best way", "best approach", "strategy for", "system for", "routine for"]
CORRECTION_PHRASES = ["correction:", "i misspoke", "i was wrong", "i got that wrong", "to correct myself", "i need to correct", "that's wrong,", "to correct that,", "i meant ", "no, it's ", "no, he's ", "no, she's ", "no, they're ", "it's actually ", "it is actually ", "actually, it's ", "actually, he's ", "actually, she's ", "actually, they're "]
AFFECT_TERMS = ["angry", "sad", "anxious", "excited", "afraid", "frustrated", "happy", "proud", "surprised", "confused", "hurt", "nervous", "grateful", "relieved", "disappointed", "awful", "amazing", "terrible", "wonderful", "great", "fantastic", "incredible", "beautiful", "lovely", "loving", "loved", "love", "enjoy", "enjoyed", "enjoying", "hate", "hated", "miss", "missing", "tired", "rough", "tough", "exhausted", "drained", "overwhelmed", "stressed", "annoyed", "bored", "sick", "lonely", "scared", "scary", "fear", "fearful", "worried", "worry", "dread", "dreading", "panic", "panicked", "terrified", "uneasy", "shaken", "unsettled", "heartbroken", "devastated", "ashamed", "guilty", "regretful", "bitter", "resentful", "betrayed", "blindsided", "humiliated"]

# Boosts of record types, bonuses and targets of relations in the graph.
TYPE_BOOST = {"evidence": 3.0, "claim": 2.6, "pattern": 2.4, "skeptical_review": 2.2, "artifact": 2.0, "report": 1.8, "contradiction_log": 1.7, "episode": 1.4, "decision": 1.2, "open_loop": 1.1, "state": 1.0, "entity": 0.8, "knowledge": 0.7, "confirmation": 0.6, "schedule": 0.4}
RELATION_BONUS = {"supporting_evidence": 0.5, "linked_claims": 0.45, "linked_evidence": 0.4, "linked_patterns": 0.4, "contradicting_evidence": 0.35, "supporting_records": 0.35, "linked_episodes": 0.3, "counterexamples": 0.3, "artifact_provenance": 0.25, "entities": 0.25, "evidence": 0.25, "claims": 0.25, "links": 0.2}
DEFAULT_RELATION_BONUS = 0.15
EDGE_WHITELIST = [
    ("artifact", ["evidence", "claim"], ["linked_evidence", "linked_claims", "artifact_provenance", "links"]),
    ("evidence", ["claim"], ["linked_claims", "links"]),
    ("evidence", ["artifact"], ["artifact_provenance", "links"]),
    ("claim", ["evidence"], ["supporting_evidence", "contradicting_evidence", "links"]),
    ("claim", ["artifact"], ["artifact_provenance", "links"]),
    ("claim", ["claim", "contradiction_log"], ["contradicting_evidence", "links"]),
    ("claim", ["pattern"], ["linked_patterns", "links"]),
    ("pattern", None, ["supporting_records", "counterexamples", "links"]),
    ("episode", ["entity", "evidence", "claim"], ["entities", "evidence", "claims", "links"]),
    ("entity", ["episode", "claim", "open_loop"], ["links"]),
    ("decision", ["open_loop"], ["links"]),
    ("open_loop", ["decision"], ["links"]),
]
# Phrases of the classes of claims, the first class that matches first.
CLAIM_CLASSES = {
    "identity_claim": ["always", "never", "i am ", "i'm ", "identity", "person"],
    "interpretation": ["feel", "seems", "appears", "maybe", "might", "probably", "likely"],
    "value_statement": ["should", "need to", "must", "have to", "ought"],
    "prediction": ["will ", "next ", "tomorrow", "soon", "expect"],
}

# By field, the allowed values, other names of them, and the default.
USUAL_VALUES = {
    "claim_class": (
        ["observation", "inference", "interpretation", "prediction", "motive_hypothesis", "value_statement", "identity_claim", "psychological_hypothesis", "self_report"],
        {"preference": "value_statement", "opinion": "value_statement", "subjective_assessment": "interpretation", "subjective": "interpretation", "assessment": "interpretation", "belief": "interpretation", "decision": "value_statement", "intention": "value_statement", "motivation": "motive_hypothesis"},
        "interpretation",
    ),
    "claim_owner": ([], {"user": "user", "me": "user", "myself": "user", "i": "user", "agent": "agent", "assistant": "agent", "writer": "agent", "skeptic": "agent", "interlocutor": "agent", "elicitor": "agent", "dreamer": "agent", "analyst": "agent"}, "external_actor"),
    "claim_status": (
        ["active", "disputed", "confirmed", "rejected", "stale", "superseded"],
        {"unverified": "disputed", "tentative": "disputed", "provisional": "disputed", "pending": "disputed", "needs_revision": "disputed", "under_review": "disputed", "review_later": "disputed", "draft": "disputed", "candidate": "active"},
        "active",
    ),
    "claim_privacy": (
        ["personal", "personal_sensitive", "family", "legal", "work", "financial", "health", "children", "business", "sealed"],
        {"public": "personal", "private": "personal", "sensitive": "personal_sensitive", "restricted": "personal_sensitive", "confidential": "personal_sensitive"},
        "personal",
    ),
    "source_type": (
        ["email", "text", "calendar", "ticket", "document", "financial_txn", "chat", "journal", "browser_event", "git_commit", "file", "manual_note", "checkin", "other", "markdown", "pdf", "image", "email_export", "sms_export"],
        {"transcript": "markdown", "transcript_entry": "markdown", "transcript_excerpt": "text", "conversation": "chat", "chat_transcript": "chat", "note": "manual_note"},
        "manual_note",
    ),
    "sensitivity": (["low", "medium", "high", "restricted", "sealed"], {"private": "restricted", "personal": "restricted", "personal_sensitive": "restricted", "sensitive": "restricted", "confidential": "restricted", "secret": "sealed"}, "low"),
}
# Days that a state of each category holds, other names of categories, and words that point to them.
STATE_TTLS = {"physical": 14, "environmental": 30, "financial": 30, "relational": 14, "work": 14, "status": 60, "appearance": 30, "competence": 60, "social_presence": 30, "desirability": 30}
STATE_CATEGORY_NAMES = {"pets": "environmental", "pet": "environmental", "home": "environmental", "household": "environmental", "family_school": "status", "school": "status", "education": "status", "productivity": "work", "routine": "work", "habit": "work"}
STATE_CATEGORY_WORDS = [
    ("environmental", ["cat", "dog", "pet", "animal"]),
    ("status", ["school", "teacher", "class", "grade", "placement", "student"]),
    ("work", ["morning", "routine", "workflow", "productivity", "capture"]),
    ("relational", ["mom", "dad", "wife", "husband", "daughter", "son", "family"]),
]

# Words of claims that a professional should review.
REVIEWED_BY_PROFESSIONALS = ["criminal", "custody", "elder abuse", "abuse", "medical", "diagnosis", "symptoms", "tax", "insurance fraud", "fraud", "legal obligation", "custody implication", "medication", "prescription"]

# Compartments that a search opens, and the words that open them.
COMPARTMENTS = {
    "legal": ["legal", "lawsuit", "contract", "attorney", "court"],
    "health": ["health", "medical", "doctor", "diagnosis", "therapy"],
    "children": ["child", "children", "kid", "custody", "school"],
}
# What a type adds to the former score, and words that ask for patterns.
FORMER_BOOST = {"artifact": 1.8, "evidence": 1.5, "pattern": 1.4, "claim": 1.2, "skeptical_review": 1.1, "report": 1.0, "episode": 0.9}
PATTERN_WORDS = ["pattern", "hypothesis", "loop", "trigger", "gap"]

# Words that do not name the subject of a decision.
DECISION_STOPWORDS = ["a", "an", "and", "are", "be", "been", "being", "but", "by", "for", "from", "have", "has", "had", "i", "if", "in", "into", "is", "it", "its", "my", "of", "on", "or", "our", "so", "the", "their", "this", "that", "to", "was", "we", "will", "with", "you", "your", "changed", "change", "mind", "again", "instead", "back", "still", "now", "want", "wants", "wanting", "keep", "kept", "use", "used", "using", "directly"]
# Words that do not count in a hypothesis, marks of one that is too broad, and diagnostic words.
HYPOTHESIS_STOPWORDS = ["the", "a", "an", "and", "or", "of", "to", "for", "with", "in", "on", "at", "by", "is", "it", "as", "be", "are", "was", "were", "that", "this", "from", "into", "when", "if", "while", "may", "might", "about", "than", "their", "my", "your", "our", "his", "her", "its", "them", "they", "i", "we", "you"]
BROAD_MARKERS = ["always", "never", "everyone", "no one", "everything", "all the time", "nothing but", "only reason", "the only reason", "all of"]
DIAGNOSTIC_TERMS = ["narcissistic", "borderline", "autistic", "bipolar", "trauma disorder", "personality disorder", "pathological", "delusional", "paranoid"]
# Statuses of patterns, former names of them, and words by which claims and evidence are reviewed.
PATTERN_STATUSES = ["candidate", "active_hypothesis", "skeptic_reviewed", "supported", "integrated", "disputed", "stale", "rejected", "retired"]
FORMER_PATTERN_STATUSES = {"active": "active_hypothesis", "confirmed": "supported", "superseded": "retired"}
HOSTILE_WORDS = ["scapegoat", "hostile", "sabotage", "malicious", "targeted", "punish"]
STATED_WORDS = ["asked", "said", "requested", "noted", "scheduled", "confirmed"]
DENIED_WORDS = ["did not", "never", "no evidence", "contradict", "disagree"]
AVOIDING_WORDS = ["avoid", "avoidance", "delay", "procrast", "defer"]

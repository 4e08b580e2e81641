"""Phrases, patterns, thresholds and lookup rows that results depend on."""

from __future__ import annotations

# Java regex flags: Unicode classes and boundaries, newline as the only line terminator.
FLAGS = "(?Ud)"

# --- fixed values: garbage patterns looked for in generated text, checked in this order ---
GARBAGE_PATTERNS = [
    ("empty_code_blocks", r"(?:```\s*[a-z]*\s*```\s*){2}"),
    ("repeated_dollar_signs", r"\$\s*\$\s*\$\s*\$+"),
    ("dollar_n_pattern", r"\$\s*n\s*\$\s*\$\s*n+"),
    ("file_permission_fragments", r"r-[-rwxs]{8,}"),
    ("txt_fragments", r"txt,txt,txt"),
    ("comma_separated_words", r"\w,(?:\w+,){4}"),
    ("repeated_connectors", r"and,and|or,or|the,the"),
]

# --- fixed values: signs that a context window overflowed; names are pattern_0, pattern_1, ... ---
OVERFLOW_PATTERNS = [
    r"-rw-r--r--.*?root.*?\d+[KMG]?",
    r"drwx.*?root.*?\d+[KMG]?",
    r"(?:```\s*[a-z]*\s*```\s*){2}",
    r"\$\s*\$\s*\$\s*\$+",
    r"\$\s*n\s*\$\s*\$\s*n+",
    r"r-[-rwxs]{8,}",
    r"total\s+\d+K\s*$",
    r"drwx[-rwxs]{8,}\s+\d+\s+\w+\s+\w+",
    r"txt,txt,txt",
    r",,+",
    r"\.\.+\w+\.\.+\w+\.\.+",
    r"\w,(?:\w+,){4}",
    r"and,and|or,or|the,the",
    r"<\|[a-z]+\|>",
]

# --- fixed values: the short overflow list used by the severity score ---
SEVERE_PATTERNS = [
    r"-rw-r--r--.*?root.*?\d+[KMG]?",
    r"\$\s*\$\s*\$\s*\$+",
    r"txt,txt,txt",
    r"\w\.\w+\.\w+\.\w",
]

# --- fixed values: a capitalised word followed by a verb-like word ending in s or ed ---
SUBJECT_VERB = r"\b[A-Z][a-z]+\b.*?\b[a-z]+(?:s|ed)\b"
CAPITALISED_WORD = r"\b[A-Z][a-z]+\b"

# --- fixed values: words ignored by the repetition score ---
COMMON_WORDS = ["the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "and", "or"]

# --- fixed values: phrases that ask to go on despite uncertainty, and phrases that end a chat ---
CONTINUATION_PHRASES = ["please continue", "continue anyway", "speculate anyway", "continue", "go on"]
EXIT_PHRASES = ["exit", "q"]

# --- fixed values: texts returned instead of a filtered answer ---
FALLBACK_MESSAGES = [
    "I don't have sufficient information to answer this question reliably.",
    "I'm uncertain about this topic and don't want to provide potentially incorrect information.",
    "I'm not confident in my ability to provide a good answer to this question.",
    "I'm not able to provide a satisfactory answer about this topic.",
]
DISCLAIMER = (
    "Note: I'm not entirely confident about this information, but as requested, "
    "I'll provide my best attempt:\n\n"
)
OVERFLOW_LEAD = "I started generating an answer but encountered issues maintaining coherence. "
LOW_QUALITY_LEAD = "I'm having trouble formulating a clear response to this question. "
FILE_HINT = " I should be able to help with files and tables, so you may want to retry your question."

# --- fixed values: threshold nudges by query wording (pattern, threshold, amount) ---
QUERY_NUDGES = [
    (r"\b(?:API|code|programming|function|algorithm|technical)\b", "entropy", 0.2),
    (r"\bwhat is\b|\bwho is\b|\bwhen did\b|\bwhere is\b", "confidence", 0.03),
    (r"\bcalculate\b|\bcompute\b|\bsolve\b|\bhow many\b", "confidence", 0.03),
]

# --- fixed values: thresholds by domain (confidence, entropy, perplexity, memory weight) ---
DOMAIN_THRESHOLDS = {
    "arithmetic": (0.55, 2.8, 15.0, 0.4),
    "factual": (0.50, 3.0, 18.0, 0.9),
    "translation": (0.40, 3.8, 20.0, 0.8),
    "conceptual": (0.45, 3.5, 22.0, 0.6),
    "procedural": (0.45, 3.5, 22.0, 0.7),
}
BASE_THRESHOLDS = (0.45, 3.5, 25.0, 0.6)

# --- fixed values: sampling caps by domain (temperature, top_p) ---
DOMAIN_SAMPLING = {
    "arithmetic": (0.3, 0.85),
    "translation": (0.4, 0.9),
    "factual": (0.5, 0.95),
    "conceptual": (0.7, 0.9),
    "procedural": (0.6, 0.9),
}

# Classifier labels carry other names than the domain tables; opt-in mapping between the two.
LABEL_TO_DOMAIN = {
    "declarative": "factual",
    "procedural_knowledge": "procedural",
    "conceptual_knowledge": "conceptual",
}

# --- fixed values: category rules on lower-cased text, first match wins ---
CATEGORY_RULES = [
    ("declarative", r"\b(what is|who is|where is|when did|tell me about)\b"),
    ("declarative", r"\b(facts|information|details|data)\b.*\b(about|on|regarding)\b"),
    ("declarative", r"\bdefine\b.*"),
    ("declarative", r"\bexplain\b.*\b(concept|term|meaning)\b"),
    ("procedural_knowledge", r"\b(how to|how do I|steps to|guide for|instructions for)\b"),
    ("procedural_knowledge", r"\b(process|method|technique|approach|procedure)\b"),
    ("procedural_knowledge", r"\b(steps|instructions|guide)\b.*\b(for|to)\b"),
    ("experiential", r"\b(what was it like|how did you feel|your experience|share experience)\b"),
    ("experiential", r"\b(personal|firsthand|lived|direct)\b.*\b(experience|account|story)\b"),
    ("experiential", r"\bhave you ever\b"),
    ("experiential", r"\bwhat happens when\b"),
    ("tacit", r"\b(intuition|gut feeling|judgment|sense)\b"),
    ("tacit", r"\b(what do you think|in your opinion|your perspective)\b"),
    ("tacit", r"\bwhat would you do\b"),
    ("tacit", r"\badvice\b.*\b(on|about|for)\b"),
    ("explicit", r"\b(manual|guide|documentation|specifications)\b"),
    ("explicit", r"\b(according to|as stated in|referenced in)\b"),
    ("explicit", r"\b(published|written|documented)\b"),
    ("explicit", r"\b(article|paper|book|journal)\b.*\b(say|state|mention)\b"),
    ("conceptual_knowledge", r"\b(theory|principle|concept|framework)\b"),
    ("conceptual_knowledge", r"\b(why|reason for|explanation for)\b"),
    ("conceptual_knowledge", r"\b(philosophy|ideology|doctrine)\b"),
    ("conceptual_knowledge", r"\b(fundamentals|basics|essence)\b.*\b(of|about)\b"),
    ("contextual", r"\b(context|environment|setting|circumstances)\b"),
    ("contextual", r"\b(cultural|social|historical|political)\b.*\b(context|background|framework)\b"),
    ("contextual", r"\b(during|in the context of|considering)\b"),
    ("contextual", r"\b(given|under|within)\b.*\b(conditions|circumstances|situation)\b"),
]

# --- fixed values: heuristics for content no classifier could place ---
CONTENT_RULES = [
    ("declarative", r"\b(what is|who is|where is|when did)\b"),
    ("procedural_knowledge", r"\b(how to|how do I|steps to)\b"),
    ("conceptual_knowledge", r"\b(theory|principle|concept|framework)\b"),
    ("explicit", r"\b(manual|guide|documentation|book|publication)\b"),
    ("experiential", r"\b(experience|feeling|what it's like)\b"),
    ("tacit", r"\b(opinion|think|suggest|recommend|advise)\b"),
    ("contextual", r"\b(context|environment|setting|circumstances)\b"),
]

# --- fixed values: subcategories of each category, in match order ---
SUBCATEGORIES = {
    "declarative": [
        "historical", "scientific", "geographic", "mathematical", "linguistic",
        "cultural", "biographical", "legal", "technological", "literary",
    ],
    "procedural_knowledge": [
        "cooking", "programming", "mechanical", "artistic", "musical",
        "sports", "medical", "crafting", "language_usage", "problem_solving",
    ],
    "experiential": [
        "travel", "work", "social", "personal", "educational",
        "cultural_immersion", "volunteer", "leadership", "creative", "life_lessons",
    ],
    "tacit": [
        "intuition", "emotional_intelligence", "leadership_insights", "problem_solving_instincts",
        "decision_making", "creative_insights", "negotiation", "communication",
        "relationship_building", "personal_judgment",
    ],
    "explicit": [
        "manuals", "textbooks", "research_papers", "tutorials", "instructional_videos",
        "policy_documents", "training_materials", "academic_articles",
        "software_documentation", "legal_contracts",
    ],
    "conceptual_knowledge": [
        "scientific_theories", "philosophical_concepts", "mathematical_theories", "economic_theories",
        "sociological_theories", "psychological_theories", "political_theories", "ethical_concepts",
        "literary_themes", "design_principles",
    ],
    "contextual": [
        "cultural_norms", "historical_context", "economic_environment", "political_climate",
        "social_dynamics", "geographic_influences", "technological_landscape",
        "organizational_culture", "market_trends", "legal_framework",
    ],
}

# --- fixed values: settings by category ---
#     (memory_weight, sharpening_factor, confidence_threshold, retrieval_count)
CATEGORY_SETTINGS = {
    "declarative": (0.9, 0.5, 0.5, 12),
    "procedural_knowledge": (0.7, 0.3, 0.5, 10),
    "experiential": (0.8, 0.4, 0.5, 6),
    "tacit": (0.5, 0.2, 0.4, 5),
    "explicit": (0.9, 0.6, 0.6, 8),
    "conceptual_knowledge": (0.6, 0.3, 0.4, 8),
    "contextual": (0.7, 0.3, 0.5, 10),
}
DEFAULT_SETTINGS = (0.8, 0.3, 0.6, 8)
UNSURE_SETTINGS = (0.5, 0.2, 0.6, 6)

# --- fixed values: stored item type by category ---
CATEGORY_TYPES = {
    "declarative": "fact", "factual": "fact", "explicit": "fact",
    "procedural": "procedure", "procedural_knowledge": "procedure",
    "conceptual": "concept", "conceptual_knowledge": "concept",
    "experiential": "experience", "tacit": "experience",
    "contextual": "context",
}

# --- fixed values: topic patterns ---
NOUN_PHRASE = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
DOMAIN_TERMS = [
    r"\b(artificial intelligence|machine learning|python|javascript|programming|database|cloud computing)\b",
    r"\b(physics|chemistry|biology|astronomy|mathematics|geology|quantum mechanics)\b",
    r"\b(medicine|health|disease|treatment|symptoms|diagnosis|wellness|nutrition)\b",
    r"\b(finance|marketing|management|entrepreneurship|investment|economics|strategy)\b",
    r"\b(literature|music|painting|sculpture|dance|theater|photography|film)\b",
]
TOPIC_VERB_PHRASE = r"\b(?:[A-Z][a-z]+ )+(?:is|are|was|were|has|have)\b"

# --- fixed values: wording that tells a category is already explicit in a text ---
STORAGE_FORMS = [
    ("procedural_knowledge", None, r"\b(steps|first|begin|start|how to)\b", "How to: "),
    ("declarative", 200, r"\b(is|are|was|were|has|have|had)\b", "This information states that "),
    ("conceptual_knowledge", 200, r"\b(concept|theory|principle|framework)\b", "The concept explained: "),
]

# --- fixed values: confidence colour steps, best first ---
COLOUR_STEPS = [0.8, 0.7, 0.6, 0.5, 0.4, 0.0]

# --- fixed values: file blocks, directives and stop markers ---
FILE_BLOCK = r">>>\s*FILE:\s*([^\n]+)\s*\n([\s\S]*?)\n\s*<<<"
SAVE_DIRECTIVE = r"@\{([^}]+)\}"
SHELL_DIRECTIVE = r"!\{([^}]+)\}"
SHELL_DISABLED = "[Shell command execution is disabled]"
STOP_MARKERS = ["<|user|>", "<|assistant|>"]
UNSAFE_FILENAME = r'[<>:"/\\|?*]'
CODE_SIGNS = ["def ", "function", "class ", "import ", "from ", "#!/bin/"]
FILESYSTEM_SIGNS = ["Filesystem", "Mounted on", "/dev/"]


def java(pattern: str) -> str:
    """The pattern as Spark's regex functions need it."""
    return FLAGS + pattern


def starting(pattern: str, first: str) -> str:
    """The pattern with a cheap test of the first character in front of its word boundary.

    The boundary test looks up Unicode properties; the character class rules out most
    positions before it. ``first`` must hold every character a match can start with.
    """
    return f"(?=[{first}])" + pattern

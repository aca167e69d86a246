"""Word lists, patterns and thresholds that decide results."""

from __future__ import annotations

# Keyword and the tag that it yields, in order of priority.
TAG_KEYWORDS = (
    ("python", "python"), ("javascript", "javascript"), ("typescript", "typescript"), ("react", "react"), ("api", "api"), ("database", "database"), ("testing", "testing"),
    ("deploy", "deployment"), ("security", "security"), ("performance", "performance"), ("marketing", "marketing"), ("advertis", "advertising"), ("brand", "branding"), ("seo", "seo"),
    ("social media", "social-media"), ("email", "email-marketing"), ("funnel", "funnels"), ("lead", "lead-generation"), ("sales", "sales"), ("negotiat", "negotiation"),
    ("prospect", "prospecting"), ("closing", "closing"), ("pricing", "pricing"), ("copywriting", "copywriting"), ("storytell", "storytelling"), ("persuas", "persuasion"),
    ("psycholog", "psychology"), ("habit", "habits"), ("productivity", "productivity"), ("discipline", "discipline"), ("mindset", "mindset"), ("finance", "finance"), ("invest", "investing"),
    ("budget", "budgeting"), ("entrepreneur", "entrepreneurship"), ("startup", "startups"), ("leadership", "leadership"), ("team", "teamwork"), ("hire", "hiring"), ("customer", "customers"), ("product", "product"),
)
# Categories by keyword of a tag, in order of priority.
CATEGORY_KEYWORDS = (
    ("marketing", ("marketing", "advertis", "brand", "seo", "funnel", "social-media", "email-marketing", "lead-generation")),
    ("writing", ("copywriting", "storytell")),
    ("sales", ("sales", "negotiat", "prospect", "closing")),
    ("product", ("pricing", "product", "ux")),
    ("business", ("entrepreneur", "startup", "business", "strategy", "operations")),
    ("finance", ("finance", "invest", "budget", "accounting")),
    ("personal-development", ("productivity", "habit", "discipline", "mindset", "time-management", "goals")),
    ("psychology", ("persuas", "psycholog", "influence", "behavior")),
    ("leadership", ("leadership", "teamwork", "hiring", "communication", "management")),
    ("technology", ("technology", "software", "automation", "api", "coding", "ai")),
)
# Patterns of unit types, tried in this order at the start of a line; group 2 is the content.
UNIT_PATTERNS = (
    ("skill", r"(Skill|Technique|Method|Strategy|Approach)[:\-]\s*(.+)"),
    ("best_practice", r"(Best\s*Practice|Pro\s*Tip|Recommendation|Guideline|Rule\s*of\s*Thumb)[:\-]\s*(.+)"),
    ("anti_pattern", r"(Anti[\-\s]*Pattern|Common\s*Mistake|Pitfall|Avoid|Watch\s*Out)[:\-]\s*(.+)"),
    ("workflow", r"(Step\s+\d+|Phase|Stage|Process|Workflow)[:\-]\s*(.+)"),
    ("rule", r"(Rule\s+\d+|Principle|Law|Always|Never)[:\-]?\s*(.+)"),
    ("example", r"(Example|For\s+example|For\s+instance|e\.g\.)[:\-]?\s*(.+)"),
)
# Confidence of a unit type before its length counts; others start at 0.4.
BASE_CONFIDENCE = {"skill": 0.5, "best_practice": 0.6, "anti_pattern": 0.6}
# Other names of unit types, and the types.
TYPE_ALIASES = {"best_practices": "best_practice", "anti_patterns": "anti_pattern", "mistake": "common_mistake", "work_flow": "workflow", "workflow_steps": "workflow", "check_list": "checklist", "decisiontree": "decision_tree"}
UNIT_TYPES = ("skill", "best_practice", "anti_pattern", "rule", "workflow", "checklist", "example", "template", "framework", "decision_tree", "common_mistake", "reference")
# Keywords of introductory skills.
PREREQUISITE_KEYWORDS = ("before", "prerequisite", "pre-requisite", "prereq", "prep", "first", "foundation", "intro", "introduction", "beginner", "basics", "basic", "getting started", "crash course", "101", "fundamentals")
# Words of titles in lower case, and words dropped from the end of names.
ARTICLES = ("a", "an", "the", "of", "for", "and", "or", "to", "in", "on", "with")
TRAILING = ("technique", "method", "strategy", "approach")
# Stop words of embeddings.
STOPWORDS = (
    "a", "about", "above", "after", "again", "all", "an", "and", "are", "as", "at", "be", "because", "been", "before", "being", "below", "between",
    "both", "but", "by", "can", "could", "did", "do", "does", "down", "during", "each", "every", "few", "for", "from", "further", "had", "has",
    "have", "here", "how", "if", "in", "into", "is", "it", "its", "just", "may", "might", "more", "most", "must", "no", "nor", "not", "of", "off",
    "on", "once", "only", "or", "other", "out", "over", "own", "same", "shall", "should", "so", "some", "such", "than", "that", "the", "then",
    "there", "these", "this", "those", "through", "to", "too", "under", "up", "very", "was", "were", "when", "where", "while", "why", "will", "with",
    "would",
)
# Stop words of content comparison.
CONTENT_STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "can", "could", "should",
    "may", "might", "shall", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before", "after", "above",
    "below", "between", "out", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very",
    "just", "because", "and", "but", "or", "if", "while", "that", "this", "it", "its",
)
# Lines that cleaning drops, matched on the stripped line.
DROPPED_LINES = (r"(?i)^page\s+\d+$", r"^\d+\s*/\s*\d+$", r"(?i)^copyright\s+©?\s*\d{4}.*$", r"(?i)^all\s+rights?\s+reserved\.?$", r"^_{10,}$", r"^[-=]{20,}$")
HEADING = r"(?i)^(#{1,4}\s+|(chapter|section|part|appendix)\s+\d+[.:]?\s*)"
# Thresholds of duplicates (cosine, name, content) and of relations (cosine, tags, name, units).
DUPLICATE = (0.85, 0.75, 0.60)
RELATED = (0.7, 0.4, 0.6, 0.3)
# Notes of the review on what a record lacks, in order; the note if it lacks nothing; feedback by status.
REVIEW_NOTES = {
    "description": "description is too short (<= 50 chars)",
    "best_practices": "no best practices",
    "workflow": "no workflow",
    "pitfalls": "no pitfalls",
    "examples": "no examples",
    "tags": "tags/category missing or sparse",
}
REVIEW_NAMELESS = ("Skill name is empty; cannot be approved.", "name is empty")
REVIEW_COMPLETE = "all criteria met: description, examples, workflow, pitfalls, tags/category"
REVIEW_FEEDBACK = {
    "approved": "Skill is well-structured and ready for approval.",
    "reviewed": "Skill is acceptable but needs improvements before approval.",
    "rejected": "Skill lacks essential sections; needs rework or rejection.",
}

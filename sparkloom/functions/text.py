"""Text rules as native column expressions: filters, intents, confidence, names, markers, entities."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- Fixed values: word lists, patterns and thresholds that results depend on. All patterns are met in lower case. ----

GREETINGS = ("hello", "hi", "hey", "hi there", "hello there", "good morning", "good afternoon", "good evening")
ACKNOWLEDGEMENTS = (
    "ok", "okay", "yes", "no", "yeah", "yep", "nope", "thanks", "thank you", "got it", "understood", "sure", "right", "correct", "exactly",
    "sounds good", "sounds great", "looks good", "looks great", "perfect", "great", "awesome", "nice", "cool",
)
GREETING_STARTS = ("hello!", "hi!", "hey!", "hello,", "hi,", "hey,", "hello.", "hi.", "hey.")
PREAMBLES = (
    r"^(now\s+)?let\s+me\s+(try|check|fetch|read|run|search|look|see|find|get|create|update|fix|test|verify|examine|review|inspect|analyze)",
    r"^i'?ll\s+(try|check|fetch|read|run|search|look|see|find|get|create|update|fix|test|verify|help|start|begin)",
    r"^(now\s+)?i'?ll\s+",
    r"^let'?s\s+(try|check|see|look|start|begin|run|test)",
    r"^(good|great|perfect|excellent)[,.]?\s*(now|let)",
    r"^(now|next|first|then)[,:]?\s*(let me|i'?ll|let'?s)",
    r"^(okay|ok|alright)[,.]?\s*(now|let|i'?ll)",
    r"^(here'?s?|this is)\s+(the|what)",
    r"^the (output|result|error|file|code) (is|shows|says)",
    r"^(and\s+)?(now|next)\s+",
    r"^moving on",
    r"^continuing with",
)
SUBSTANTIVE = (
    r"\bbecause\b",
    r"\bthe (reason|issue|problem|solution|key|important|main)\b",
    r"\bdecided\b",
    r"\bshould\b.*\bbecause\b",
    r"\binstead of\b",
    r"\brather than\b",
    r"\bthe approach\b",
    r"\bwe need to\b.*\bto\b",
)
NARRATION = (
    r"^(the command|it|this) (completed|succeeded|failed|ran|finished|returned|shows|outputs)",
    r"^(running|executing|checking|reading|fetching|creating)",
    r"^(done|complete|success|finished)[.!]?$",
    r"^(no errors?|all (tests? )?pass(ed|ing)?)[.!]?$",
)
SYSTEM = (r"^\[request interrupted", r"^\[user cancelled", r"^\[tool (error|timeout|failed)", r"^<system")
INSTRUCTIONS = (
    r"^(please\s+)?(run|try|check|fix|update|create|delete|show|list|find|search)\s+it\b",
    r"^(please\s+)?(run|try|check|fix|update|create|delete|show|list|find|search)\s+this\b",
    r"^(please\s+)?(run|try|check|fix|update|create|delete|show|list|find|search)\s+that\b",
    r"^go\s*(ahead)?[.!]?$",
    r"^(do it|proceed|continue)[.!]?$",
    r"^yes[,.]?\s*please[.!]?$",
    r"^okay[,.]?\s*do it[.!]?$",
)
WARMUPS = (r"^i understand\.?\s*(i'?m|i am)?\s*ready", r"^i'?m ready to help", r"^i understand this is a warmup", r"^i'?m here to help", r"^how can i (help|assist)")
INTENTS = {
    "decision": (r"^we decided", r"^i decided", r"^decided to", r"^going with", r"^i'?ll use", r"^we'?ll use", r"^let'?s use", r"^using\b", r"^chose\b", r"^choosing\b", r"the decision is", r"final decision"),
    "solution": (r"^fixed (by|it|this)", r"^the (solution|fix) is", r"^resolved (by|this)", r"^solved (by|it)", r"^to fix this", r"^the answer is", r"works now"),
    "problem": (r"^the (issue|problem) (is|with)", r"^issue:", r"^problem:", r"running into", r"struggling with", r"(is|are) (failing|broken|not working)", r"error:", r"bug:", r"doesn'?t work"),
    "conclusion": (r"^the key (insight|takeaway)", r"^in conclusion", r"^learned that", r"^the (main|key) (point|thing)", r"^takeaway:", r"^insight:", r"turns out", r"realized that"),
    "todo": (r"^need to", r"^should (implement|add|create|fix)", r"^todo:", r"^must (implement|add|create|fix)", r"^next steps?:", r"remaining work"),
    "question": (r"\?$", r"^how (should|can|do|would)", r"^what (should|is|are|would)", r"^should (we|i)", r"^which\b", r"^where\b", r"^when\b", r"^why\b", r"^can (we|you|i)", r"^is (it|there|this)"),
}
CONFIDENCE = {"decision": 0.8, "solution": 0.8, "conclusion": 0.7, "problem": 0.7, "context": 0.6, "todo": 0.5, "question": 0.5}
TENTATIVE = ("maybe", "might", "could", "perhaps", "possibly", "i think", "i guess", "not sure", "uncertain", "probably", "likely", "seems like")
FIRM = ("definitely", "certainly", "absolutely", "clearly", "decided", "confirmed", "verified", "final", "must", "will", "shall")
SHIFTS = (
    r"let'?s move on to", r"let'?s switch to", r"let'?s work on", r"let'?s discuss", r"back to the", r"now let'?s",
    r"switching to", r"moving on to", r"turning to", r"next,? let'?s", r"okay,? let'?s", r"alright,? let'?s",
)
SUBTOPICS = (
    r"specifically,", r"diving into", r"let'?s dig into", r"let'?s look at.+in detail", r"more specifically", r"in particular,", r"focusing on",
    r"to be more specific", r"regarding the.+part", r"as for the", r"on the topic of", r"breaking down", r"within that,",
)
RETURNS = (
    r"back to the bigger picture", r"stepping back,", r"zooming out,", r"returning to", r"more broadly,",
    r"on a higher level", r"overall,", r"in summary,", r"to summarize,", r"wrapping up",
)
BAD_NAMES = (
    r"^session\s*(start|begin|init)", r"^(okay|alright|now|so|well),?\s*(let'?s|we)", r"^let'?s\s+(build|start|do|work|move|switch)",
    r"^(hi|hello|hey)\b", r"^(introduction|overview|summary)$", r"^\*\*.*\*\*$", r"^(the|a|an)\s+\w+$",
)
REVIEW_NAMES = (
    r"^this session is being continued", r"^session\s*(start|begin|init)", r"^let'?s\s", r"now let'?s\s", r"^okay,?\s*(let'?s|brilliant|so)", r"^alright,?\s*let'?s",
    r"^got it", r"^seems to", r"^working with", r"^looking at", r"^\*\*", r"^#+\s", r"\.\.\.$",
)
REVIEW_NAMES_CASED = (r"^[a-z]", r"^.{80,}")
MARKUP = ((r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"`([^`]+)`", "$1"), (r"^#+\s*", ""))
NAME_STARTS = (r"(?i)^(okay|alright|now|so|well|right),?\s*", r"(?i)^let'?s\s+(now\s+)?", r"(?i)^(we should|we need to|i'?ll|we'?ll)\s+", r"(?i)^(first|next|then|finally),?\s*")
CANONICAL_STARTS = r"^(session start|let'?s|now let'?s|okay,?\s*let'?s)\s*"
SUPERSEDES = ("instead", "rather than", "changed to", "switching to", "no longer", "not anymore", "actually", "correction", "updated", "revised", "new approach")
BUILDS_ON = ("additionally", "also", "furthermore", "moreover", "building on", "extending", "adding to", "on top of", "in addition", "as well")
OVERLAP_STOPWORDS = ("this", "that", "with", "from", "have", "been", "were", "will", "would", "could", "should")
TECHNOLOGIES = (
    "postgresql", "postgres", "mysql", "sqlite", "mongodb", "redis", "elasticsearch", "kafka", "rabbitmq", "dynamodb", "cassandra",
    "python", "javascript", "typescript", "rust", "go", "golang", "java", "react", "vue", "angular", "svelte", "nextjs", "next.js",
    "node", "nodejs", "node.js", "deno", "bun", "django", "flask", "fastapi", "express", "koa", "nestjs", "docker", "kubernetes", "k8s", "terraform", "ansible",
    "aws", "gcp", "azure", "vercel", "netlify", "cloudflare", "graphql", "rest", "grpc", "websocket", "websockets", "sse", "jwt", "oauth", "oauth2", "openid",
    "esp32", "arduino", "raspberry pi", "stm32", "lora", "sx1262", "git", "github", "gitlab", "bitbucket", "pg", "js", "ts",
)
CANONICAL_NAMES = {
    "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "pg": "PostgreSQL", "mysql": "MySQL", "mongodb": "MongoDB", "mongo": "MongoDB", "redis": "Redis",
    "sqlite": "SQLite", "dynamodb": "DynamoDB", "elasticsearch": "Elasticsearch", "elastic": "Elasticsearch", "cassandra": "Cassandra",
    "javascript": "JavaScript", "js": "JavaScript", "typescript": "TypeScript", "ts": "TypeScript", "python": "Python", "rust": "Rust", "golang": "Go", "go": "Go", "java": "Java",
    "node": "Node.js", "nodejs": "Node.js", "node.js": "Node.js", "deno": "Deno", "bun": "Bun", "react": "React", "reactjs": "React", "vue": "Vue", "vuejs": "Vue",
    "angular": "Angular", "svelte": "Svelte", "nextjs": "Next.js", "next.js": "Next.js", "django": "Django", "flask": "Flask", "fastapi": "FastAPI", "express": "Express",
    "nestjs": "NestJS", "docker": "Docker", "kubernetes": "Kubernetes", "k8s": "Kubernetes", "terraform": "Terraform", "ansible": "Ansible",
    "aws": "AWS", "amazon web services": "AWS", "gcp": "GCP", "google cloud": "GCP", "azure": "Azure", "graphql": "GraphQL", "grpc": "gRPC",
    "websocket": "WebSocket", "websockets": "WebSocket", "jwt": "JWT", "oauth": "OAuth", "oauth2": "OAuth", "openid": "OpenID",
}
CONCEPTS = (r"(rate limiting)", r"(sliding window)", r"(connection pool\w*)", r"(load balanc\w+)", r"(caching)", r"(authentication)", r"(authorization)", r"(encryption)", r"(hashing)", r"(indexing)")
FILE_PATH = r"[\w./\-]+\.(?:py|js|ts|tsx|jsx|go|rs|java|c|cpp|h|hpp|md|json|yaml|yml|toml|sql|sh|bash)"

# ---- End of fixed values ----


def any_of(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def met(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any of the patterns is met in a text, as rlike(any_of(patterns)) says.

    Patterns that start at the beginning are tried there alone, and those that are plain letters, some of them optional, are
    looked for as such: a pattern of many branches is tried at every place of a text.
    """
    first = [p[1:] for p in patterns if p.startswith("^")]
    plain = {p: spelled(p) for p in patterns if not p.startswith("^")}
    tests = [text.rlike(f"^(?:{any_of(tuple(first))})")] if first else []
    tests += [text.contains(x) for p in plain for x in plain[p] or ()]
    rest = tuple(p for p in plain if not plain[p])
    return reduce(or_, tests + ([text.rlike(any_of(rest))] if rest else []))


def spelled(pattern: str) -> list[str] | None:
    """What a pattern of letters stands for, some of them optional (`let'?s`); None if it is another one."""
    parts = re.findall(r"([^?])(\??)", pattern)
    if "".join(a + b for a, b in parts) != pattern or re.search(r"[\\^$.*+()\[\]{}|]", pattern):
        return None
    out = [""]
    for letter, optional in parts:
        out = [x + letter for x in out] + (out if optional else [])
    return out


def strip(text: Column) -> Column:
    # A run of white space is only tried from its beginning.
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++$", "")


def held(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use names it: branches of a CASE don't share their parts."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(markers: tuple[str, ...]) -> str:
    return "|".join(markers)


def filter_reason(content: Column, has_tool_use: Column | None = None) -> Column:
    """Why a message isn't worth keeping; null if it is. Null content counts as empty. One CASE, first rule wins."""
    tool = F.lit(False) if has_tool_use is None else F.coalesce(has_tool_use, F.lit(False))
    return held(F.lower(strip(F.coalesce(content, F.lit("")))), lambda low: _reason(low, tool))


def _reason(low: Column, tool: Column) -> Column:
    size = F.char_length(low)
    preamble = met(low, PREAMBLES)
    return (
        F.when(size == 0, "empty")
        .when(size < 20, "too_short")
        .when(low.isin(*GREETINGS), "greeting")
        .when(low.isin(*ACKNOWLEDGEMENTS), "acknowledgment")
        .when((size < 50) & F.substring(low, 1, 6).rlike("^(?:" + "|".join(s.replace(".", r"\.") for s in GREETING_STARTS) + ")"), "greeting_response")
        .when(met(low, NARRATION), "tool_narration")
        .when(met(low, SYSTEM), "system_message")
        .when(met(low, WARMUPS), "warmup")
        .when((size < 50) & met(low, INSTRUCTIONS), "short_instruction")
        .when((size < 80) & preamble & ~met(low, SUBSTANTIVE), "preamble")
        .when(tool & (size < 100) & preamble, "tool_preamble")
        .when(tool & (size < 60), "short_tool_intro")
    )


def is_indexable(content: Column, has_tool_use: Column | None = None) -> Column:
    return filter_reason(content, has_tool_use).isNull()


def classify_intent(content: Column) -> Column:
    """decision, solution, problem, conclusion, todo or question by the first pattern met; else context."""

    def first(low: Column) -> Column:
        out = F
        for intent, patterns in INTENTS.items():
            out = out.when(met(low, patterns), intent)
        return out.otherwise("context")

    return held(strip(F.lower(F.coalesce(content, F.lit("")))), first)


def assess_confidence(content: Column, intent: Column) -> Column:
    """Confidence of a statement, 0.1 to 1, by its intent and its tentative and firm markers."""
    base = F
    for name, value in CONFIDENCE.items():
        base = base.when(intent == name, value)
    markers = held(F.lower(F.coalesce(content, F.lit(""))), lambda low: F.when(met(low, FIRM), 0.1).otherwise(0.0) - F.when(met(low, TENTATIVE), 0.15).otherwise(0.0))
    score = base.otherwise(0.5) + markers
    return F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), score)), 2)


def topic_shift(content: Column) -> Column:
    return held(F.lower(content), lambda low: met(low, SHIFTS))


def subtopic(content: Column) -> Column:
    return held(F.lower(content), lambda low: met(low, SUBTOPICS))


def back_to_parent(content: Column) -> Column:
    return held(F.lower(content), lambda low: met(low, RETURNS))


def supersedes(content: Column) -> Column:
    return held(F.lower(content), lambda low: met(low, SUPERSEDES))


def builds_on(content: Column) -> Column:
    return held(F.lower(content), lambda low: met(low, BUILDS_ON))


def clean_topic_name(name: Column) -> Column:
    """Without markup and opening phrases, first letter upper case, at most 80 characters, cut at a word if one ends past 40."""
    out = strip(name)
    for pattern, by in MARKUP:
        out = F.regexp_replace(out, pattern, by)
    for pattern in NAME_STARTS:
        out = F.regexp_replace(out, pattern, "")
    out = F.when(out.rlike("^[a-z]"), F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 30))).otherwise(out)
    head = F.substring(out, 1, 80)
    at = F.char_length(head) - F.instr(F.reverse(head), " ")
    cut = F.when(head.contains(" ") & (at > 40), F.substring(head, F.lit(1), at)).otherwise(head)
    return strip(F.when(F.char_length(out) > 80, cut).otherwise(out))


def canonical_topic(name: Column) -> Column:
    """Key of a topic name for finding duplicates."""
    out = F.regexp_replace(strip(F.lower(name)), CANONICAL_STARTS, "")
    out = F.regexp_replace(F.regexp_replace(out, r"[.:,;!?]+$", ""), r"\s+", " ")
    return F.substring(out, 1, 50)


def bad_topic_name(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return (F.char_length(low) < 5) | met(low, BAD_NAMES)


def review_topic_name(name: Column) -> Column:
    return held(F.lower(F.coalesce(name, F.lit(""))), lambda low: met(low, REVIEW_NAMES)) | F.coalesce(name, F.lit("")).rlike(any_of(REVIEW_NAMES_CASED))


def significant_words(content: Column) -> Column:
    """Different words of five characters and more, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(content, F.lit(""))), F.lit(r"(\b\w{5,}\b)"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in OVERLAP_STOPWORDS]))


def content_overlap(a: Column, b: Column) -> Column:
    """At least two significant words in common."""
    return F.size(F.array_intersect(significant_words(a), significant_words(b))) >= 2


def resolve_entity(name: Column, kind: Column) -> Column:
    """Canonical name of a technology; other names as they are."""
    known = F.create_map(*[F.lit(x) for pair in CANONICAL_NAMES.items() for x in pair])
    return F.when(kind == "technology", F.coalesce(F.try_element_at(known, F.lower(name)), name)).otherwise(name)


def extract_entities(content: Column, word_boundary: bool = False) -> Column:
    """array<struct<name, type>> of technologies (in canonical form), files and concepts met in a text, each once.

    A technology counts wherever its letters stand, unless word_boundary is set.
    """
    low = F.lower(F.coalesce(content, F.lit("")))
    known = F.array(*[F.struct(F.lit(t).alias("word"), F.lit(CANONICAL_NAMES.get(t, t)).alias("name")) for t in TECHNOLOGIES])
    if word_boundary:
        met = lambda s, t: F.regexp_like(s, F.concat(F.lit(r"(?<!\w)\Q"), t["word"], F.lit(r"\E(?!\w)")))
    else:
        met = lambda s, t: F.contains(s, t["word"])
    found = held(low, lambda s: F.filter(known, lambda t: met(s, t)))
    # A path starts where its run of characters starts: without the look-behind a long run would be tried at every place.
    techs = F.transform(found, lambda t: F.struct(t["name"].alias("name"), F.lit("technology").alias("type")))
    files = F.transform(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(rf"(?<![\w./\-])({FILE_PATH})"), F.lit(1)), lambda f: F.struct(f.alias("name"), F.lit("file").alias("type")))
    concepts = F.filter(
        F.array(*[F.struct(F.regexp_extract(low, p, 1).alias("name"), F.lit("concept").alias("type")) for p in CONCEPTS]), lambda c: c["name"] != ""
    )
    return F.array_distinct(F.concat(techs, files, concepts))


def estimate_tokens(content: Column) -> Column:
    return F.floor(F.char_length(content) / 4)


def tokens(content: Column) -> Column:
    """Runs of letters and digits in lower case, for keyword search."""
    return F.filter(F.split(F.lower(F.coalesce(content, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


@F.pandas_udf(T.DoubleType())
def string_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * longest common subsequence / sum of lengths, in lower case; 0 for null and empty names."""

    def one(x, y) -> float:
        if not x or not y:
            return 0.0
        x, y = x.lower(), y.lower()
        row = [0] * (len(y) + 1)
        for c in x:
            before = 0
            for j, d in enumerate(y, 1):
                before, row[j] = row[j], before + 1 if c == d else max(row[j], row[j - 1])
        return 2 * row[-1] / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

"""Rule dimension: what each detection rule looks for, how it is worded, what it costs.

A rule is an ordered list of patterns; the first pattern that matches supplies
the label of the finding.  Python rules match the two halves of a call name,
JavaScript and Java rules match a line by regular expression.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

PYTHON, JAVASCRIPT, JAVA, UNKNOWN = "python", "javascript", "java", "unknown"
LANGUAGES = (PYTHON, JAVASCRIPT, JAVA)


@dataclass(frozen=True)
class CallPattern:
    obj: str
    method: str
    label: str


@dataclass(frozen=True)
class LinePattern:
    regex: str
    label: str


@dataclass(frozen=True)
class Rule:
    rule_id: str
    language: str
    name: str
    category: str
    severity: str
    sentence: str
    suggestion: str
    patterns: Sequence[CallPattern | LinePattern]
    needs_loop: bool = True
    why: str | None = None
    # (text, category): labels containing the text get this category instead
    label_category: tuple[str, str] | None = None


def _calls(*rows: tuple[str, str, str]) -> tuple[CallPattern, ...]:
    return tuple(CallPattern(obj, method, label) for obj, method, label in rows)


def _lines(*pairs: tuple[str, str]) -> tuple[LinePattern, ...]:
    return tuple(LinePattern(regex, label) for regex, label in pairs)


# --- fixed values: names, words and patterns that decide the results -----------------

PY001_CALLS = _calls(
    ("dynamodb", "get_item", "DynamoDB get_item"),
    ("dynamodb", "query", "DynamoDB query"),
    ("dynamodb", "scan", "DynamoDB scan"),
    ("dynamodb", "put_item", "DynamoDB put_item"),
    ("table", "get_item", "DynamoDB get_item"),
    ("table", "query", "DynamoDB query"),
    ("table", "scan", "DynamoDB scan"),
    ("session", "query", "SQLAlchemy query"),
    ("session", "execute", "SQLAlchemy execute"),
    ("session", "get", "SQLAlchemy get"),
    ("db", "get", "Database get"),
    ("db", "query", "Database query"),
    ("db", "execute", "Database execute"),
    ("db", "find", "Database find"),
    ("db", "find_one", "Database find_one"),
    ("collection", "find", "MongoDB find"),
    ("collection", "find_one", "MongoDB find_one"),
    ("collection", "aggregate", "MongoDB aggregate"),
    ("redis", "get", "Redis get"),
    ("redis", "hget", "Redis hget"),
    ("redis", "hgetall", "Redis hgetall"),
    ("cursor", "execute", "SQL cursor execute"),
    ("cursor", "fetchone", "SQL cursor fetchone"),
    ("cursor", "fetchall", "SQL cursor fetchall"),
)

PY002_CALLS = _calls(
    ("requests", "get", "HTTP GET request"),
    ("requests", "post", "HTTP POST request"),
    ("requests", "put", "HTTP PUT request"),
    ("requests", "delete", "HTTP DELETE request"),
    ("requests", "patch", "HTTP PATCH request"),
    ("httpx", "get", "HTTPX GET request"),
    ("httpx", "post", "HTTPX POST request"),
    ("client", "get", "HTTP client GET"),
    ("client", "post", "HTTP client POST"),
    ("session", "get", "aiohttp GET"),
    ("session", "post", "aiohttp POST"),
    ("urllib", "urlopen", "urllib request"),
    ("request", "urlopen", "urllib request"),
    ("client", "invoke", "AWS Lambda invoke"),
    ("sns", "publish", "AWS SNS publish"),
    ("sqs", "send_message", "AWS SQS send"),
)

PY003_CALLS = _calls(
    ("json", "dumps", "JSON serialization"),
    ("json", "loads", "JSON deserialization"),
    ("pickle", "dumps", "Pickle serialization"),
    ("pickle", "loads", "Pickle deserialization"),
    ("yaml", "dump", "YAML serialization"),
    ("yaml", "load", "YAML deserialization"),
)

PY004_CALLS = _calls(
    ("cursor", "execute", "SQL query"),
    ("cursor", "fetchall", "SQL fetchall"),
    ("session", "query", "ORM query"),
    ("session", "execute", "SQLAlchemy execute"),
    ("collection", "find", "MongoDB find"),
    ("db", "query", "Database query"),
    ("db", "execute", "Database execute"),
    ("db", "find", "Database find"),
    ("table", "scan", "DynamoDB scan"),
)

PAGINATION_WORDS = (
    "limit", "offset", "top", "fetch", "first", "take",
    "page", "paginate", "pagination", "slice", "[:",
)

HOT_FUNCTION_WORDS = (
    "handle", "handler", "process", "controller", "endpoint", "route", "view", "api",
    "webhook", "lambda_handler", "main", "run", "execute", "dispatch", "serve",
)

JS_LOOPS = (
    r"\bfor\s*\(",
    r"\bwhile\s*\(",
    r"\bdo\s*\{",
    r"\.forEach\s*\(",
    r"\.map\s*\(",
    r"\.filter\s*\(",
    r"\.reduce\s*\(",
    r"\.some\s*\(",
    r"\.every\s*\(",
    r"\.find\s*\(",
    r"\.findIndex\s*\(",
    r"\bfor\s+\w+\s+of\b",
    r"\bfor\s+\w+\s+in\b",
)

JS001_LINES = _lines(
    (r"\bfetch\s*\(", "fetch() call"),
    (r"\baxios\s*\.\s*(get|post|put|delete|patch|request)\s*\(", "axios HTTP call"),
    (r"\baxios\s*\(", "axios HTTP call"),
    (r"\bhttp\s*\.\s*(get|post|put|delete|patch)\s*\(", "HTTP library call"),
    (r"\brequest\s*\(", "request() call"),
    (r"\bgot\s*\(", "got() HTTP call"),
    (r"\bsuperagent\s*\.", "superagent HTTP call"),
    (r"\$\.ajax\s*\(", "jQuery AJAX call"),
    (r"\$\.(get|post)\s*\(", "jQuery HTTP call"),
)

# The DynamoDB member pattern is known in two spellings; under
# ignore-case the second can never be reached, so it is stated once.
JS002_LINES = _lines(
    (r"\.find\s*\(", "MongoDB find()"),
    (r"\.findOne\s*\(", "MongoDB findOne()"),
    (r"\.findById\s*\(", "MongoDB findById()"),
    (r"\.findMany\s*\(", "Database findMany()"),
    (r"\.aggregate\s*\(", "MongoDB aggregate()"),
    (r"\.updateOne\s*\(", "MongoDB updateOne()"),
    (r"\.updateMany\s*\(", "MongoDB updateMany()"),
    (r"\.deleteOne\s*\(", "MongoDB deleteOne()"),
    (r"\.collection\s*\([^)]*\)\s*\.", "MongoDB collection operation"),
    (r"\bquery\s*\(", "Database query()"),
    (r"\.execute\s*\(", "Database execute()"),
    (r"DynamoDB\s*\.\s*(get|put|query|scan)", "DynamoDB operation"),
    (r"\.getItem\s*\(", "DynamoDB getItem()"),
    (r"\.putItem\s*\(", "DynamoDB putItem()"),
    (r"redis\s*\.\s*(get|set|hget|hset)", "Redis operation"),
)

# Waiting on promises (all, race, await) is fine; only creating them is reported.
JS003_LINES = _lines(
    (r"new\s+Promise\s*\(", "Promise creation"),
    (r"\basync\s+\(", "async arrow function"),
)

JS004_LINES = _lines(
    (r"JSON\s*\.\s*parse\s*\(", "JSON.parse()"),
    (r"JSON\s*\.\s*stringify\s*\(", "JSON.stringify()"),
)

JS_HOT = (
    r"(handle|handler|process|controller|endpoint|route|api|webhook|middleware)",
    r"(get|post|put|delete|patch)[A-Z]",
    r"on(Request|Response|Message|Event)",
)

JAVA_LOOPS = (
    r"\bfor\s*\(",
    r"\bwhile\s*\(",
    r"\bdo\s*\{",
    r"\.forEach\s*\(",
    r"\.stream\s*\(\s*\)\s*\.",
    r"\.parallelStream\s*\(\s*\)\s*\.",
)

JAVA001_LINES = _lines(
    (r"repository\s*\.\s*find", "Spring Data Repository find"),
    (r"repository\s*\.\s*findById", "Spring Data findById()"),
    (r"repository\s*\.\s*findAll", "Spring Data findAll()"),
    (r"repository\s*\.\s*findBy\w+", "Spring Data findBy*()"),
    (r"repository\s*\.\s*get", "Spring Data Repository get"),
    (r"repository\s*\.\s*save", "Spring Data Repository save"),
    (r"repository\s*\.\s*delete", "Spring Data Repository delete"),
    (r"Repo\s*\.\s*find", "Repository find"),
    (r"Dao\s*\.\s*find", "DAO find"),
    (r"Dao\s*\.\s*get", "DAO get"),
    (r"entityManager\s*\.\s*find", "JPA EntityManager find"),
    (r"entityManager\s*\.\s*createQuery", "JPA EntityManager createQuery"),
    (r"session\s*\.\s*get", "Hibernate Session get"),
    (r"session\s*\.\s*load", "Hibernate Session load"),
    (r"session\s*\.\s*createQuery", "Hibernate Session createQuery"),
)

JAVA002_LINES = _lines(
    (r"restTemplate\s*\.\s*getForObject", "RestTemplate getForObject()"),
    (r"restTemplate\s*\.\s*getForEntity", "RestTemplate getForEntity()"),
    (r"restTemplate\s*\.\s*postForObject", "RestTemplate postForObject()"),
    (r"restTemplate\s*\.\s*postForEntity", "RestTemplate postForEntity()"),
    (r"restTemplate\s*\.\s*exchange", "RestTemplate exchange()"),
    (r"restTemplate\s*\.\s*execute", "RestTemplate execute()"),
    (r"restTemplate\s*\.\s*delete", "RestTemplate delete()"),
    (r"restTemplate\s*\.\s*put", "RestTemplate put()"),
    (r"webClient\s*\.\s*get", "WebClient GET"),
    (r"webClient\s*\.\s*post", "WebClient POST"),
    (r"httpClient\s*\.\s*execute", "HttpClient execute"),
    (r"HttpURLConnection", "HttpURLConnection"),
    (r"\.openConnection\s*\(", "URL openConnection()"),
)

JAVA003_LINES = _lines(
    (r"objectMapper\s*\.\s*writeValueAsString", "ObjectMapper writeValueAsString()"),
    (r"objectMapper\s*\.\s*writeValueAsBytes", "ObjectMapper writeValueAsBytes()"),
    (r"objectMapper\s*\.\s*readValue", "ObjectMapper readValue()"),
    (r"objectMapper\s*\.\s*readTree", "ObjectMapper readTree()"),
    (r"mapper\s*\.\s*writeValueAsString", "ObjectMapper writeValueAsString()"),
    (r"mapper\s*\.\s*readValue", "ObjectMapper readValue()"),
    (r"gson\s*\.\s*toJson", "Gson toJson()"),
    (r"gson\s*\.\s*fromJson", "Gson fromJson()"),
    (r"Gson\s*\(\s*\)\s*\.\s*toJson", "Gson toJson()"),
)

# Iterating a result set is what loops are for, so it is not among these.
JAVA004_LINES = _lines(
    (r"jdbcTemplate\s*\.\s*query", "JdbcTemplate query()"),
    (r"jdbcTemplate\s*\.\s*queryForObject", "JdbcTemplate queryForObject()"),
    (r"jdbcTemplate\s*\.\s*queryForList", "JdbcTemplate queryForList()"),
    (r"jdbcTemplate\s*\.\s*update", "JdbcTemplate update()"),
    (r"jdbcTemplate\s*\.\s*execute", "JdbcTemplate execute()"),
    (r"statement\s*\.\s*executeQuery", "Statement executeQuery()"),
    (r"statement\s*\.\s*execute", "Statement execute()"),
    (r"preparedStatement\s*\.\s*executeQuery", "PreparedStatement executeQuery()"),
    (r"preparedStatement\s*\.\s*execute", "PreparedStatement execute()"),
    (r"connection\s*\.\s*prepareStatement", "Connection prepareStatement()"),
)

JAVA005_LINES = _lines(
    (r"dynamoDb\s*\.\s*getItem", "DynamoDB getItem()"),
    (r"dynamoDb\s*\.\s*putItem", "DynamoDB putItem()"),
    (r"dynamoDb\s*\.\s*query", "DynamoDB query()"),
    (r"dynamoDb\s*\.\s*scan", "DynamoDB scan()"),
    (r"s3Client\s*\.\s*getObject", "S3 getObject()"),
    (r"s3Client\s*\.\s*putObject", "S3 putObject()"),
    (r"snsClient\s*\.\s*publish", "SNS publish()"),
    (r"sqsClient\s*\.\s*sendMessage", "SQS sendMessage()"),
    (r"lambdaClient\s*\.\s*invoke", "Lambda invoke()"),
)

JAVA_HOT = (
    r"@(GetMapping|PostMapping|PutMapping|DeleteMapping|RequestMapping)",
    r"@(Controller|RestController|Service|Component)",
    r"(handle|process|execute|run|invoke|dispatch)\w*\s*\(",
    r"public\s+\w+\s+(handle|process|execute|controller|endpoint)",
    r"@Scheduled",
    r"@EventListener",
    r"@KafkaListener",
    r"@RabbitListener",
)

LOOPS = {JAVASCRIPT: JS_LOOPS, JAVA: JAVA_LOOPS}
HOT = {JAVASCRIPT: JS_HOT, JAVA: JAVA_HOT}
# how many preceding lines count as hot-path context
HOT_LOOKBACK = {JAVASCRIPT: 20, JAVA: 30}

# Order inside a language is emission order: the rules of one call or line report in
# this sequence.
BUILTIN_RULES: tuple[Rule, ...] = (
    Rule(
        "PY004", PYTHON, "Unbounded Query", "database_read", "medium",
        "without LIMIT or pagination. May return excessive data and incur high costs.",
        "Add LIMIT or implement pagination to prevent full table scans.",
        PY004_CALLS, needs_loop=False,
        why="Queries without LIMIT may return excessive data, increasing response time and costs.",
    ),
    Rule(
        "PY001", PYTHON, "Database Call in Loop", "database_read", "high",
        "called inside a loop. Each iteration triggers a database operation.",
        "Use JOIN or IN query to batch database operations, or use batch APIs like batch_get_item.",
        PY001_CALLS,
        why="Each loop iteration triggers a paid database operation, causing N+1 query problems.",
    ),
    Rule(
        "PY002", PYTHON, "API Call in Loop", "api_call", "high",
        "called inside a loop. Each iteration makes an external API call.",
        "Use a bulk or batch API endpoint to reduce call count.",
        PY002_CALLS,
        why="Each loop iteration triggers a paid API request, multiplying costs by iteration count.",
    ),
    Rule(
        "PY003", PYTHON, "Serialization in Loop", "serialization", "medium",
        "called inside a loop. Repeated serialization is CPU-intensive.",
        "Move serialization outside the loop if possible, or serialize a batch at once.",
        PY003_CALLS,
        why="Repeated serialization inside loops consumes CPU resources unnecessarily.",
    ),
    Rule(
        "JS001", JAVASCRIPT, "API Call in Loop", "api_call", "high",
        "detected inside a loop. Each iteration makes a network request.",
        "Move the API call outside the loop, or use Promise.all() after collecting all requests.",
        JS001_LINES,
    ),
    Rule(
        "JS002", JAVASCRIPT, "Database Call in Loop", "database_read", "high",
        "detected inside a loop. Each iteration queries the database.",
        "Use batch operations or aggregate queries instead of individual calls per iteration.",
        JS002_LINES,
    ),
    Rule(
        "JS003", JAVASCRIPT, "Async Fan-out in Loop", "api_call", "medium",
        "inside a loop creates unbounded concurrent operations.",
        "Collect promises and use Promise.all() with concurrency limits, or use for...of with await.",
        JS003_LINES,
    ),
    Rule(
        "JS004", JAVASCRIPT, "Serialization in Loop", "serialization", "medium",
        "inside a loop. Repeated serialization is CPU-intensive.",
        "Move serialization outside the loop if possible, or batch serialize.",
        JS004_LINES,
    ),
    Rule(
        "JAVA001", JAVA, "Spring Data Call in Loop", "database_read", "high",
        "detected inside a loop. Each iteration queries the database.",
        "Use batch operations like findAllById() or custom batch queries instead.",
        JAVA001_LINES,
    ),
    Rule(
        "JAVA002", JAVA, "HTTP Call in Loop", "api_call", "high",
        "detected inside a loop. Each iteration makes an HTTP request.",
        "Batch API calls or use async/parallel execution with WebClient.",
        JAVA002_LINES,
    ),
    Rule(
        "JAVA003", JAVA, "Serialization in Loop", "serialization", "medium",
        "detected inside a loop. Repeated JSON serialization is CPU-intensive.",
        "Batch serialize by collecting objects into a list and serializing once.",
        JAVA003_LINES,
    ),
    Rule(
        "JAVA004", JAVA, "JDBC Call in Loop", "database_read", "high",
        "detected inside a loop. Each iteration executes a database query.",
        "Use batch operations or prepare the query once outside the loop.",
        JAVA004_LINES,
    ),
    Rule(
        "JAVA005", JAVA, "AWS SDK Call in Loop", "api_call", "high",
        "detected inside a loop. Each iteration makes an AWS API call.",
        "Use batch operations like BatchGetItem or batch write for DynamoDB.",
        JAVA005_LINES, label_category=("DynamoDB", "database_read"),
    ),
)

# --- end of fixed values --------------------------------------------------------------


def rules_for(language: str, rules: Iterable[Rule] = BUILTIN_RULES) -> list[Rule]:
    return [r for r in rules if r.language == language]

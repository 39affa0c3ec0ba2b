"""Service-level graph: datastores, queues, calls and libraries found in source text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import text as tx
from codeloom.operators.containment import containing, contains_join

Settle = Callable[[DataFrame, str], DataFrame]
FILE_KEY = ("repo_id", "file_path")

# Connection calls by service language, with the kind of store they open.
DATABASE_CALLS = {
    "python": (
        ("psycopg2.connect", "postgres"),
        ("create_engine(", "postgres"),
        ("asyncpg.create_pool", "postgres"),
        ("MongoClient(", "mongodb"),
        ("redis.Redis(", "redis"),
        ("redis.StrictRedis(", "redis"),
        ("boto3.resource('dynamodb')", "dynamodb"),
        ("sqlite3.connect", "sqlite"),
        ("chromadb.PersistentClient", "chromadb"),
        ("GraphDatabase.driver", "neo4j"),
    ),
    "javascript typescript": (
        ("pg.Pool(", "postgres"),
        ("new Pool(", "postgres"),
        ("createPool(", "mysql"),
        ("mongoose.connect(", "mongodb"),
        ("new MongoClient(", "mongodb"),
        ("redis.createClient(", "redis"),
        ("new Redis(", "redis"),
        ("createClient({", "redis"),
        ("new Sequelize(", "postgres"),
        ("DynamoDBClient(", "dynamodb"),
        ("createClient({ url", "supabase"),
        ("PrismaClient", "postgres"),
        ("knex(", "postgres"),
    ),
    "go": (
        ("sql.Open(", "postgres"),
        ("pgx.Connect(", "postgres"),
        ("gorm.Open(", "postgres"),
        ("mongo.Connect(", "mongodb"),
        ("redis.NewClient(", "redis"),
        ("dynamodb.New(", "dynamodb"),
        ("bolt.Open(", "sqlite"),
        ("neo4j.NewDriver(", "neo4j"),
    ),
    "java": (
        ("DriverManager.getConnection(", "postgres"),
        ("@Repository", "postgres"),
        ("JdbcTemplate", "postgres"),
        ("new MongoClient(", "mongodb"),
        ("MongoClients.create(", "mongodb"),
        ("JedisPool(", "redis"),
        ("RedisConnectionFactory", "redis"),
        ("EntityManager", "postgres"),
    ),
}

# Queue clients by service language.
QUEUE_CALLS = {
    "python": (
        ("boto3.client('sqs')", "sqs"),
        ("pika.BlockingConnection", "rabbitmq"),
        ("KafkaProducer(", "kafka"),
        ("KafkaConsumer(", "kafka"),
    ),
    "javascript typescript": (
        ("new Kafka(", "kafka"),
        ("kafkajs", "kafka"),
        ("amqplib.connect(", "rabbitmq"),
        ("new SQSClient(", "sqs"),
        ("new Bull(", "redis"),
        ("new Queue(", "redis"),
        ("PubSub(", "pubsub"),
    ),
    "go": (
        ("kafka.NewWriter(", "kafka"),
        ("sarama.NewClient(", "kafka"),
        ("amqp.Dial(", "rabbitmq"),
        ("sqs.New(", "sqs"),
        ("pubsub.NewClient(", "pubsub"),
    ),
    "java": (
        ("KafkaProducer(", "kafka"),
        ("@KafkaListener", "kafka"),
        ("RabbitTemplate", "rabbitmq"),
        ("@RabbitListener", "rabbitmq"),
        ("AmazonSQS", "sqs"),
        ("@SqsListener", "sqs"),
    ),
}

# HTTP clients by service language, and ways to read an address from the environment.
HTTP_CALLS = {
    "python": ("requests.", "httpx.", "httpx.AsyncClient", "aiohttp.ClientSession", "urllib.request"),
    "javascript typescript": (
        "fetch(", "axios.get(", "axios.post(", "axios.request(", "axios.create(", "http.get(",
        "got.get(", "superagent.get(",
    ),
    "go": ("http.Get(", "http.Post(", "http.NewRequest(", "client.Do("),
    "java": ("HttpClient", "RestTemplate", "WebClient", "HttpURLConnection", "OkHttpClient"),
}
ENV_READS = ("process.env.", "os.getenv(", "os.environ[", "System.getenv(", "os.Getenv(")
ENV_VARIABLE = (
    r"(?:process\.env\.|os\.getenv\(|os\.environ\[|os\.environ\.get\(|System\.getenv\(|"
    r"os\.Getenv\(|envvar=)\s*[\"']?([A-Z_][A-Z0-9_]*)[\"']?"
)
ADDRESS_WORDS = ("URL", "HOST", "ENDPOINT", "BASE", "API", "SERVER")
URL_HOST = r"[\"']https?://([^\"'/:]+)"
RPC_NAME = r"(?:call_edge_function|functions\.invoke)\s*\(\s*[\"']([^\"']+)[\"']"
UNRESOLVED = "external:env_url"

# Manifests, and dependencies that mark an infrastructure repository.
MANIFESTS = ("package.json", "requirements.txt", "go.mod", "pom.xml", "build.gradle")
IMPORTING_SUFFIXES = (".py", ".js", ".ts", ".go", ".java")
INFRASTRUCTURE = (
    (
        ("typescript", "javascript"),
        ("package.json",),
        ("aws-cdk", "aws-cdk-lib", "@aws-cdk/core", "cdktf", "@pulumi/pulumi", "serverless", "sst"),
    ),
    (("python",), ("requirements.txt", "Pipfile", "pyproject.toml"), ("aws-cdk-lib", "pulumi", "cdktf")),
    (
        ("go",),
        ("go.mod",),
        (
            "github.com/pulumi/pulumi",
            "github.com/aws/aws-cdk-go",
            "github.com/hashicorp/terraform-cdk-go",
        ),
    ),
)
TERRAFORM_SUFFIXES = (".tf", ".tfvars")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _contains_any(column: str, needles: tuple[str, ...]) -> Column:
    """Some needle occurs in a column; one parsed expression builds faster than many calls."""
    return F.expr(" OR ".join(f"contains({column}, {_sql_text(n)})" for n in needles))


def _by_language(table: dict, value) -> Column:
    """The entry of ``table`` for the row's service language, as built by ``value``."""
    out = F.lit(None)
    for languages, entry in table.items():
        out = F.when(F.col("service_language").isin(languages.split()), value(entry)).otherwise(out)
    return out


def _pattern_hits(patterns: dict, code: Column, describe) -> Column:
    """``describe(kind, position)`` of each pattern of the service's language in the code.

    The pattern tables are constants of the plan, so nothing is joined and every file is
    searched where it lies.
    """
    def as_array(entries) -> Column:
        rows = (f"named_struct('pattern', {_sql_text(p)}, 'kind', {_sql_text(k)})" for p, k in entries)
        return F.expr(f"array({', '.join(rows)})")

    found = F.filter(
        F.transform(
            _by_language(patterns, as_array),
            lambda p: F.struct(
                p["kind"].alias("kind"), F.instr(code, p["pattern"]).alias("position")
            ),
        ),
        lambda hit: hit["position"] > 0,
    )
    return F.transform(found, lambda hit: describe(hit["kind"], hit["position"]))


def _found(pattern: str, needles: tuple[str, ...], where: Column) -> Column:
    """Distinct first groups of a pattern in a file, none where the file does not qualify.

    Every match holds one of the ``needles``; files without any skip the pattern.
    """
    texts = F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))
    none = F.array().cast("array<string>")
    return F.when(_contains_any("content", needles) & where, texts).otherwise(none)


def file_facts(files: DataFrame) -> DataFrame:
    """What one reading of each file tells the service graph, without its text.

    Input ``repo_id, file_path, content, service_language``. Output ``repo_id, file_path`` and
    arrays: ``stores`` and ``queues`` (kind, name, direction), ``hosts``, ``variables``,
    ``rpc_names``, ``quoted`` (names a manifest quotes or pins), ``imported`` and ``mentioned``
    (rests of import lines; of a line's mentions the first, whose rest holds the later ones). Comments and literals are blanked once per file.
    """
    content = F.col("content")

    def fallback(found: Column, kind: Column, tail: str) -> Column:
        return F.coalesce(found, F.concat(F.lit("shared_"), kind, F.lit(tail)))

    def stores(code: Column) -> Column:
        return _pattern_hits(
            DATABASE_CALLS,
            code,
            lambda kind, position: F.struct(
                kind.alias("kind"),
                fallback(tx.database_name(content, kind), kind, "_db").alias("name"),
                tx.io_direction(code, position).alias("direction"),
            ),
        )

    def queues(code: Column) -> Column:
        return _pattern_hits(
            QUEUE_CALLS,
            code,
            lambda kind, position: F.struct(
                kind.alias("kind"),
                fallback(tx.queue_name(content), kind, "_queue").alias("name"),
                tx.io_direction(code, position).alias("direction"),
            ),
        )

    def where_named(patterns: dict, hits: Callable[[Column], Column]) -> Column:
        """The hits, none at once where the code holds no pattern."""
        named = _by_language(patterns, lambda entries: _contains_any("code", tuple(p for p, _ in entries)))
        none = F.array().cast("array<struct<kind:string,name:string,direction:string>>")
        return F.when(~named, none).otherwise(tx.let(F.col("code"), hits))

    client = _by_language(HTTP_CALLS, lambda needles: _contains_any("code", needles))
    reads_env = _contains_any("content", ENV_READS)
    name = tx.base_name(F.col("file_path"))
    is_manifest = name.isin(list(MANIFESTS))
    is_code = tx.suffix(F.col("file_path")).isin(list(IMPORTING_SUFFIXES))
    pinned = _found(r" ([^\s\"'=]+)==", ("==",), is_manifest)
    quoted = [_found(rf"(?={q}([^{q}\n]+){q})", (q,), is_manifest) for q in ('"', "'")]
    scanned = files.withColumn("code", tx.blank_code(content))
    calls_out = reads_env | F.coalesce(client, F.lit(False))
    return scanned.select(
        "repo_id",
        "file_path",
        where_named(DATABASE_CALLS, stores).alias("stores"),
        where_named(QUEUE_CALLS, queues).alias("queues"),
        _found(URL_HOST, ("://",), calls_out).alias("hosts"),
        F.filter(
            _found(ENV_VARIABLE, ADDRESS_WORDS, reads_env), lambda v: v.rlike("|".join(ADDRESS_WORDS))
        ).alias("variables"),
        _found(RPC_NAME, ("call_edge_function", "functions.invoke"), calls_out).alias("rpc_names"),
        F.array_distinct(F.concat(*quoted, pinned)).alias("quoted"),
        _found(r"(?:from|import)\s+(?=([^\n]+))", ("from", "import"), is_code).alias("imported"),
        _found(r"(?:import|require)([^\n]+)", ("import", "require"), is_code).alias("mentioned"),
    )


def _file_note(**entries: Column) -> Column:
    pairs = [x for name, value in entries.items() for x in (F.lit(name), value)]
    return F.create_map(*pairs)


def _resource_edges(facts: DataFrame, column: str, prefix: str, kind: Column) -> DataFrame:
    hits = tx.exploded(facts, FILE_KEY, F.col(column), "hit")
    return hits.select(
        F.col("repo_id").alias("source_id"),
        F.concat_ws(":", F.lit(prefix), "hit.kind", "hit.name").alias("target_id"),
        kind.alias("kind"),
        _file_note(file=tx.base_name(F.col("file_path"))).alias("metadata"),
        F.col("hit.kind").alias("node_kind"),
        F.col("hit.name").alias("node_name"),
    )


def datastore_edges(facts: DataFrame) -> DataFrame:
    """``source_id, target_id, kind, metadata, node_kind, node_name`` for stores a file opens."""
    kind = F.concat(F.lit("db_"), F.col("hit.direction"))
    return _resource_edges(facts, "stores", "datastore", kind)


def queue_edges(facts: DataFrame) -> DataFrame:
    kind = F.when(F.col("hit.direction") == "write", "queue_publish").otherwise("queue_consume")
    return _resource_edges(facts, "queues", "queue", kind)


def slug(name: Column) -> Column:
    return F.lower(F.translate(name, "-_", ""))


def url_edges(facts: DataFrame, services: DataFrame) -> DataFrame:
    """Hard-coded URLs whose host contains another service's name (``-`` and ``_`` aside)."""
    hosts = tx.exploded(facts, FILE_KEY, F.col("hosts"), "host").withColumn(
        "host_slug", slug(F.col("host"))
    )
    named = services.select("service_id", slug(F.col("service_id")).alias("slug"))
    found = containing(hosts, "host_slug", named, "slug").join(named, "slug")
    return found.where(F.col("service_id") != F.col("repo_id")).select(
        F.col("repo_id").alias("source_id"),
        F.col("service_id").alias("target_id"),
        F.lit("http_call").alias("kind"),
        _file_note(url=F.col("host"), file=tx.base_name(F.col("file_path"))).alias("metadata"),
    )


def bare_variable(name: Column) -> Column:
    out = name
    for part in ("_URL", "_HOST", "_API", "_"):
        out = F.replace(out, F.lit(part), F.lit(""))
    return F.lower(out)


def env_targets(variables: DataFrame, services: DataFrame) -> DataFrame:
    """Smallest service, other than the reader, whose name contains the bare variable or is
    contained in it; ``external:env_url`` when there is none.

    Input ``repo_id, variable``. A bare variable of no characters fits every service: the two
    smallest service ids answer it for every reader. Per variable the two smallest matches are
    enough as well, because at most one of them is the reader itself.
    """
    asked = variables.select("repo_id", "variable").distinct().withColumn(
        "bare", bare_variable(F.col("variable"))
    )
    named = services.select("service_id", slug(F.col("service_id")).alias("slug"))
    bare = asked.select("bare").distinct()
    pairs = contains_join(bare, named, "bare", "slug").unionByName(
        contains_join(named, bare, "slug", "bare")
    )
    matches = pairs.distinct().join(named, "slug").select("bare", "service_id").distinct()
    anywhere = named.orderBy("service_id").limit(2).select(F.lit("").alias("bare"), "service_id")
    place = F.row_number().over(Window.partitionBy("bare").orderBy("service_id"))
    best = (
        matches.unionByName(anywhere)
        .withColumn("place", place)
        .where(F.col("place") <= 2)
        .groupBy("bare")
        .agg(F.array_sort(F.collect_list("service_id")).alias("candidates"))
    )
    chosen = F.get(F.filter("candidates", lambda s: s != F.col("repo_id")), 0)
    return asked.join(best, "bare", "left").select(
        "repo_id", "variable", F.coalesce(chosen, F.lit(UNRESOLVED)).alias("target_id")
    )


def env_edges(facts: DataFrame, services: DataFrame) -> DataFrame:
    reads = tx.exploded(facts, FILE_KEY, F.col("variables"), "variable")
    resolved = reads.join(env_targets(reads, services), ["repo_id", "variable"])
    name = tx.base_name(F.col("file_path"))
    return resolved.select(
        F.col("repo_id").alias("source_id"),
        "target_id",
        F.lit("http_call").alias("kind"),
        F.when(F.col("target_id") == UNRESOLVED, _file_note(env_var=F.col("variable"), file=name))
        .otherwise(
            _file_note(
                env_var=F.col("variable"), file=name,
                note=F.lit("resolved via env-var heuristic name matching"),
            )
        )
        .alias("metadata"),
    )


def path_names(paths: DataFrame) -> DataFrame:
    """``service_id, name``: every path part and file stem a service contains."""
    parts = F.array_union(
        F.split("file_path", "/"), F.array(tx.stem(F.col("file_path")))
    )
    return paths.select(
        F.col("repo_id").alias("service_id"), F.explode(parts).alias("name")
    ).distinct()


def rpc_edges(facts: DataFrame, paths: DataFrame) -> DataFrame:
    """RPC calls to the first other service that has a folder or file of that name.

    Per name only the two smallest services are kept before the calls meet them: at most one
    of the two can be the caller itself.
    """
    sites = tx.exploded(facts, FILE_KEY, F.col("rpc_names"), "name")
    names = path_names(paths)
    first = names.groupBy("name").agg(F.min("service_id").alias("first"))
    second = (
        names.join(first, "name")
        .where(F.col("service_id") > F.col("first"))
        .groupBy("name")
        .agg(F.min("service_id").alias("second"))
    )
    target = F.when(F.col("first") != F.col("repo_id"), F.col("first")).otherwise(F.col("second"))
    joined = sites.join(first.join(second, "name", "left"), "name").withColumn("target", target)
    return joined.where(F.col("target").isNotNull()).select(
        F.col("repo_id").alias("source_id"),
        F.col("target").alias("target_id"),
        F.lit("rpc_call").alias("kind"),
        _file_note(
            rpc_method=F.col("name"),
            file=tx.base_name(F.col("file_path")),
            note=F.lit("resolved via RPC directory match in target repo"),
        ).alias("metadata"),
    )


def service_names(services: DataFrame) -> DataFrame:
    """``service_id, name``: a service's own name and its spelling with dashes."""
    spelled = F.array_distinct(
        F.array(F.col("service_id"), F.replace("service_id", F.lit("_"), F.lit("-")))
    )
    return services.select("service_id", F.explode(spelled).alias("name"))


def manifest_edges(facts: DataFrame, services: DataFrame) -> DataFrame:
    """Manifests that quote another service's name or pin it with ``==`` after a space.

    The names a manifest holds are known from its reading and joined by equality.
    """
    tokens = tx.exploded(facts, FILE_KEY, F.col("quoted"), "name")
    return _library_edges(tokens.join(service_names(services), "name"), "manifest dependency")


def import_edges(facts: DataFrame, services: DataFrame) -> DataFrame:
    """Sources that import another service: ``from|import name`` or a later mention on an
    ``import`` or ``require`` line."""
    names = service_names(services).withColumn("module", F.replace("name", F.lit("-"), F.lit("_")))
    starts = tx.exploded(facts, FILE_KEY, F.col("imported"), "tail")
    mentions = tx.exploded(facts, FILE_KEY, F.col("mentioned"), "tail")
    direct = containing(starts, "tail", names, "module", prefix_only=True).join(names, "module")
    later = containing(mentions, "tail", names, "name").join(names, "name")
    columns = ["repo_id", "file_path", "service_id"]
    both = direct.select(*columns).unionByName(later.select(*columns))
    return _library_edges(both, "source import")


def _library_edges(found: DataFrame, note: str) -> DataFrame:
    other = found.where(F.col("service_id") != F.col("repo_id"))
    return other.select("repo_id", "service_id", "file_path").distinct().select(
        F.col("repo_id").alias("source_id"),
        F.col("service_id").alias("target_id"),
        F.lit("library_dependency").alias("kind"),
        _file_note(file=tx.base_name(F.col("file_path")), note=F.lit(note)).alias("metadata"),
    )


def service_types(files: DataFrame) -> DataFrame:
    """``service_id, service_type``: infrastructure by manifest or Terraform file, else service."""
    name = tx.base_name(F.col("file_path"))
    marks = [
        F.col("service_language").isin(list(languages))
        & name.isin(list(manifests))
        & _contains_any("content", words)
        for languages, manifests, words in INFRASTRUCTURE
    ]
    marks.append(tx.suffix(F.col("file_path")).isin(list(TERRAFORM_SUFFIXES)))
    return files.groupBy(F.col("repo_id").alias("service_id")).agg(
        F.when(F.max(_any(marks)), "infrastructure").otherwise("service").alias("service_type")
    )


def detect_dependencies(
    files: DataFrame, services: DataFrame, settle: Settle = lambda rows, name: rows
) -> tuple[DataFrame, DataFrame]:
    """Resource nodes (``repo_id`` is their user) and service edges of all files.

    ``files`` has ``repo_id, file_path, content``, ``services`` at least ``service_id,
    language``. Every file is read once, into its facts; ``settle`` may write those so that the
    seven detectors share them.
    """
    languages = services.select(
        F.col("service_id").alias("repo_id"), F.col("language").alias("service_language")
    )
    facts = settle(file_facts(files.join(languages, "repo_id")), "facts")
    return link(facts, services, facts)


def link(facts: DataFrame, services: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resource nodes and service edges of the repositories in ``facts``.

    ``services`` and ``paths`` (``repo_id, file_path``) are those of all repositories: what facts
    may point to. Of edges with the same triple one is kept, the last by its note.
    """
    from codeloom.operators.keyed import largest_text

    stores, queues = datastore_edges(facts), queue_edges(facts)
    columns = ["source_id", "target_id", "kind", "metadata"]
    edges = stores.select(*columns)
    for more in (
        queues,
        url_edges(facts, services),
        env_edges(facts, services),
        rpc_edges(facts, paths),
        manifest_edges(facts, services),
        import_edges(facts, services),
    ):
        edges = edges.unionByName(more.select(*columns))
    noted = edges.select("source_id", "target_id", "kind", F.to_json("metadata").alias("_note"))
    unique = largest_text(noted, ["source_id", "target_id", "kind"], "_note").select(
        "source_id", "target_id", "kind",
        F.from_json("_note", "map<string,string>").alias("metadata"),
    )
    resources = (
        stores.withColumn("node_type", F.lit("datastore"))
        .unionByName(queues.withColumn("node_type", F.lit("queue")))
        .select(
            F.col("source_id").alias("repo_id"), F.col("target_id").alias("node_id"), "node_type",
            F.col("node_kind").alias("kind"), F.col("node_name").alias("name"),
        )
        .distinct()
    )
    return resources, unique

"""Agent data steps as batch DataFrame operators.

Prompt assembly, routing, per-route drafts and answer scoring run over a
whole table of questions at once: conversation text comes from an
equi-join with the master table (not one lookup per request), the context
summary is a one-row aggregate broadcast to every question, and model calls
run in ``mapInPandas`` with the caller's function, a window of them at a time
(see ``functions/calls.py``).  Model outputs are written out before they are
reused, so lineage never calls the model twice, and finished calls are kept in
a journal until then.
"""

from __future__ import annotations

import shutil
import time
from collections import deque
from collections.abc import Callable

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlytics.functions.calls import Caller, CallPolicy, Journal, in_order, local_path
from convlytics.functions.jsonudf import inspect_answer, is_strict_json, parse_json_lenient
from convlytics.operators.metrics import context_summary
from convlytics.operators.ranking import attach_one_row

# Keys a well-formed agent answer carries.
EXPECTED_KEYS = ["summary", "insights", "risks", "actions", "metrics_used"]

# Routes with a specialised node; anything else is 'assistant'.
ROUTES = ["escalar", "tecnico", "resumen"]
DEFAULT_ROUTE = "assistant"

# The system prompt template ({contexto} is filled per batch).
SYSTEM_PROMPT_TEMPLATE = (
    "Rol: Analista de operaciones de una aerolinea.\n"
    "Objetivo: Responder preguntas de negocio con base en metricas.\n"
    "Restricciones: No revelar razonamiento interno. No usar emojis.\n"
    "Formato de salida: JSON con llaves summary, insights, risks, actions, metrics_used.\n"
    "Ejemplo de salida:\n"
    "{\n"
    '  "summary": "La tasa de escalamiento es elevada en ciertos estados.",\n'
    '  "insights": ["Los hilos con mas mensajes muestran mayor escalamiento."],\n'
    '  "risks": ["Falsos negativos impactan la satisfaccion del cliente."],\n'
    '  "actions": ["Priorizar mejora en los estados con mayor tasa."],\n'
    '  "metrics_used": ["tasa_escalamiento", "mensajes_promedio"]\n'
    "}\n\n"
    "Contexto:\n{contexto}"
)
SEMANTIC_HEADER = "\n\nContexto semantico relevante:\n"

# The router instruction.
ROUTER_PROMPT = (
    "Rol: Analista de conversaciones automatizado.\n"
    "Tarea: Clasificar sentimiento y motivo, y decidir la ruta.\n"
    "Reglas de ruteo:\n"
    "- Si el sentimiento es negativo o hay queja fuerte: route = escalar\n"
    "- Si la consulta es tecnica: route = tecnico\n"
    "- Si la conversacion parece resuelta: route = resumen\n"
    "- Si no hay thread_id o conversacion: route = assistant\n"
    "Devuelve SOLO JSON con llaves: route, sentiment, motivo, rationale.\n"
)

# Prompts of the three specialised nodes, by route.
ROUTE_PROMPTS = {
    "escalar": (
        "Rol: Analista de conversaciones automatizado.\n"
        "Tarea: Generar salida de escalamiento a humano.\n"
        "Devuelve SOLO JSON con llaves: action, sentiment, motivo, summary, next_steps.\n"
        "action debe ser 'escalar_humano'."
    ),
    "tecnico": (
        "Rol: Analista de conversaciones automatizado.\n"
        "Tarea: Generar borrador de respuesta tecnica.\n"
        "Devuelve SOLO JSON con llaves: action, sentiment, motivo, respuesta, assumptions.\n"
        "action debe ser 'borrador_tecnico'."
    ),
    "resumen": (
        "Rol: Analista de conversaciones automatizado.\n"
        "Tarea: Generar resumen final de conversacion resuelta.\n"
        "Devuelve SOLO JSON con llaves: action, sentiment, motivo, summary, resolution.\n"
        "action debe ser 'resumen'."
    ),
}

ChatFn = Callable[[str, str], str]


def normalize_route(col) -> F.Column:
    """Known routes pass; anything else, NULL included, becomes 'assistant'."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isin(*ROUTES), c).otherwise(F.lit(DEFAULT_ROUTE))


def system_prompts(questions: DataFrame, master: DataFrame, context: DataFrame | None = None,
                   id_col: str = "question_id") -> DataFrame:
    """Adds ``system_prompt``: template + metrics summary (+ retrieved context when non-empty).

    ``context`` (optional) has (query_id, context) rows keyed like ``id_col``.
    """
    summary = context_summary(master)  # one row, broadcast
    head, tail = SYSTEM_PROMPT_TEMPLATE.split("{contexto}")
    out = attach_one_row(questions, summary).withColumn(
        "system_prompt", F.concat(F.lit(head), F.col("summary"), F.lit(tail))
    ).drop("summary")
    if context is not None:
        ctx = context.select(F.col("query_id").alias(id_col), F.col("context").alias("_ctx"))
        out = out.join(ctx, id_col, "left").withColumn(
            "system_prompt",
            F.when(F.coalesce(F.col("_ctx"), F.lit("")) != "",
                   F.concat(F.col("system_prompt"), F.lit(SEMANTIC_HEADER), F.col("_ctx")))
            .otherwise(F.col("system_prompt")),
        ).drop("_ctx")
    return out


def call_model(df: DataFrame, chat_fn: ChatFn, system_col: str, user_col: str, out_col: str = "response",
               timed: bool = False, on_error: str = "raise", policy: CallPolicy = CallPolicy(),
               journal: str | None = None) -> DataFrame:
    """Runs ``chat_fn(system, user)`` for every row, several calls at a time in each task.

    Passing errors are retried as ``policy`` says.  A call that fails for good
    ends the job (after Spark's task retries), unless ``on_error`` is
    "capture": then the error text is the response, as an evaluation of the
    model wants it.  With ``timed`` the elapsed seconds per row, waits
    included, go to ``elapsed_s``.  ``journal`` is a folder that all executors
    see as files: finished calls are kept there and not made again.
    """
    if on_error not in ("raise", "capture"):
        raise ValueError(f"on_error must be raise or capture, not {on_error!r}")
    fields = list(df.schema.fields) + [T.StructField(out_col, T.StringType())]
    if timed:
        fields.append(T.StructField("elapsed_s", T.DoubleType()))

    def run(batches):
        book = Journal(journal, TaskContext.get().partitionId()) if journal else None
        call = Caller(chat_fn, policy)
        held: deque = deque()

        def rows():
            for pdf in batches:
                if pdf.empty:
                    continue
                held.append(pdf)
                for system, user in zip(pdf[system_col], pdf[user_col]):
                    yield system, user, book.key(system, user) if book else None

        def answer(system, user, key):
            if book and key in book.known:
                return book.known[key]["answer"], book.known[key]["elapsed"]
            t0 = time.time()
            try:
                out = call(system, user)
            except Exception as exc:  # noqa: BLE001 - a model may raise anything
                if on_error == "raise":
                    raise
                out = str(exc)
            elapsed = time.time() - t0
            if book:
                book.add(key, out, elapsed)
            return out, elapsed

        done: list = []
        try:
            for got in in_order(answer, rows(), policy.window):
                done.append(got)
                if len(done) == len(held[0]):
                    pdf = held.popleft().copy()
                    pdf[out_col] = [r for r, _ in done]
                    if timed:
                        pdf["elapsed_s"] = [t for _, t in done]
                    done = []
                    yield pdf
        finally:
            if book:
                book.close()

    return df.mapInPandas(run, schema=T.StructType(fields))


def staged_calls(calls: Callable[[str | None], DataFrame], spark: SparkSession, staging_path: str) -> DataFrame:
    """Writes the rows of ``calls(journal)`` to ``staging_path`` and reads them back.

    The journal lies beside the table while the job runs; a run after a failed
    one finds it, and it goes when the table is complete.  In stores that only
    Spark can read there is no journal, and a task that is lost calls again.
    """
    folder = local_path(staging_path)
    journal = f"{folder.rstrip('/')}.calls" if folder else None
    calls(journal).write.mode("overwrite").parquet(staging_path)
    if journal:
        shutil.rmtree(journal, ignore_errors=True)
    return spark.read.parquet(staging_path)


def score_answers(df: DataFrame, text_col: str = "answer") -> DataFrame:
    """Adds the answer-quality fields of each answer text.

    json_valido, claves_presentes, claves_faltantes (sorted),
    score_estructura (= present / 5), insights_no_vacios, actions_no_vacios.
    A JSON value that is not an object scores 0 with every key missing.
    """
    expected = F.array(*[F.lit(k) for k in sorted(EXPECTED_KEYS)])
    info = inspect_answer(F.col(text_col))
    out = df.withColumn("_i", info)
    present = F.array_sort(F.array_intersect(expected, F.col("_i.keys")))
    return (
        out.withColumn("json_valido", F.col("_i.valid"))
        .withColumn("claves_presentes", present)
        .withColumn("claves_faltantes", F.array_sort(F.array_except(expected, present)))
        .withColumn("score_estructura", F.size(present) / F.lit(float(len(EXPECTED_KEYS))))
        .withColumn("insights_no_vacios", F.array_contains("_i.lists", "insights"))
        .withColumn("actions_no_vacios", F.array_contains("_i.lists", "actions"))
        .drop("_i")
    )


def answer_quality_summary(scored: DataFrame, time_col: str = "tiempo_s") -> DataFrame:
    """One row: mean structure score, valid answers, total answers, mean time."""
    return scored.agg(
        F.avg("score_estructura").alias("score_promedio"),
        F.sum(F.col("json_valido").cast("long")).alias("respuestas_validas"),
        F.count(F.lit(1)).alias("total"),
        F.avg(time_col).alias("tiempo_promedio"),
    )


def evaluate_answers(questions: DataFrame, master: DataFrame, chat_fn: ChatFn, staging_path: str,
                     question_col: str = "question", id_col: str = "question_id", policy: CallPolicy = CallPolicy()) -> DataFrame:
    """Answer every question in isolation, time it and score it.

    Output: id, pregunta (first 80 chars), tiempo_s (2 decimals) and the
    answer-quality fields.  Answers are written to ``staging_path`` first.
    """
    prompts = system_prompts(questions.select(id_col, question_col), master, id_col=id_col)
    got = staged_calls(lambda journal: call_model(prompts, chat_fn, "system_prompt", question_col, "answer", timed=True, on_error="capture",
                                                  policy=policy, journal=journal).drop("system_prompt"),
                       questions.sparkSession, staging_path)
    scored = score_answers(got, "answer")
    return scored.select(
        id_col, F.substring(question_col, 1, 80).alias("pregunta"), F.round("elapsed_s", 2).alias("tiempo_s"),
        "json_valido", "claves_presentes", "claves_faltantes", "score_estructura",
        "insights_no_vacios", "actions_no_vacios",
    )


def router_inputs(requests: DataFrame, master: DataFrame, question_col: str = "question") -> DataFrame:
    """Adds ``conversation`` (from the master table, '' if unknown) and ``router_input``.

    Build ``master`` with ``thread_ids=requests`` so that only the requested
    conversations are put together.
    """
    conv = master.groupBy(F.col("thread_id").cast("string").alias("thread_id")).agg(
        F.min("full_conversation").alias("conversation")
    )
    j = requests.withColumn("thread_id", F.col("thread_id").cast("string")).join(conv, "thread_id", "left")
    j = j.withColumn("conversation", F.coalesce("conversation", F.lit("")))
    text = F.concat(
        F.lit("thread_id: "), F.coalesce(F.col("thread_id"), F.lit("None")),
        F.lit("\nconversacion:\n"), F.col("conversation"),
        F.lit("\n\npregunta_actual:\n"), F.coalesce(F.col(question_col), F.lit("")),
    )
    return j.withColumn("router_input", text)


def route_requests(requests: DataFrame, master: DataFrame, chat_fn: ChatFn, staging_path: str,
                   question_col: str = "question", policy: CallPolicy = CallPolicy()) -> DataFrame:
    """Adds ``analysis`` (lenient JSON of the router reply) and ``route``."""
    inp = router_inputs(requests, master, question_col).withColumn("router_prompt", F.lit(ROUTER_PROMPT))
    got = staged_calls(lambda journal: call_model(inp, chat_fn, "router_prompt", "router_input", "router_reply",
                                                  policy=policy, journal=journal).drop("router_prompt"),
                       requests.sparkSession, staging_path)
    analysed = got.withColumn("analysis", parse_json_lenient(F.col("router_reply")))
    raw_route = F.get_json_object(F.col("analysis"), "$.route")
    return analysed.withColumn("route", normalize_route(raw_route))


def draft_by_route(routed: DataFrame, chat_fn: ChatFn, staging_path: str, policy: CallPolicy = CallPolicy()) -> DataFrame:
    """Adds ``draft`` from the specialised prompt of the row's route.

    Rows of route 'assistant' keep a NULL draft: :func:`system_prompts` and
    :func:`call_model` answer them like any question.
    """
    spark = routed.sparkSession
    prompts = spark.createDataFrame(list(ROUTE_PROMPTS.items()), "route string, route_prompt string")
    j = routed.join(F.broadcast(prompts), "route", "left")  # 3-row dimension
    todo = j.filter(F.col("route_prompt").isNotNull()).withColumn(
        "_user", F.concat(F.lit("analisis: "), F.col("analysis"), F.lit("\n\nconversacion:\n"), F.col("conversation"))
    )
    rest = j.filter(F.col("route_prompt").isNull()).drop("route_prompt").withColumn("draft", F.lit(None).cast("string"))


    def drafted(journal):
        return call_model(todo, chat_fn, "route_prompt", "_user", "draft", policy=policy, journal=journal).drop("_user", "route_prompt")

    return staged_calls(lambda journal: drafted(journal).unionByName(rest), spark, staging_path)


def strict_json_answers(df: DataFrame, answer_col: str = "answer") -> DataFrame:
    """Rows whose whole answer is strict JSON (the ones worth saving to memory)."""
    return df.filter(is_strict_json(F.col(answer_col)))


def session_transcript(messages: DataFrame, session_col: str = "session_id", msg_id_col: str = "message_id",
                       seq_col: str = "seq", role_col: str = "role", text_col: str = "text",
                       hot_rows: int | None = None) -> DataFrame:
    """Per session: the ordered '<role>: <text>' log, one line per message id.

    A message id that appears more than once keeps its latest version
    (highest ``seq``), as a message log that replaces equal ids does.  Hot
    sessions are split by ``seq`` slice before concatenation.
    """
    from convlytics.operators.master import HOT_THREAD_ROWS
    from convlytics.operators.textagg import ordered_concat

    latest = messages.groupBy(session_col, msg_id_col).agg(
        F.max_by(F.struct(F.col(seq_col).alias("seq"), F.col(role_col).alias("role"), F.col(text_col).alias("text")),
                 F.col(seq_col)).alias("_m")
    ).select(session_col, F.col("_m.seq").alias("_seq"), F.concat(F.col("_m.role"), F.lit(": "), F.col("_m.text"))
             .alias("_line"))
    return ordered_concat(latest, session_col, "_line", ["_seq"], "\n", "transcript",
                          hot_rows if hot_rows is not None else HOT_THREAD_ROWS, count_col="n_messages")

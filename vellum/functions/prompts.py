"""Prompt text assembled from ranked contexts (R6) and the instruction template (R7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# The system instruction sent with a context prompt, and the template pieces.
SYSTEM_PROMPT = (
    "You are a helpful AI assistant. Use the provided context to answer the user's question. "
    "If the context doesn't contain relevant information, use your knowledge to provide the best response."
)
INSTRUCTION_HEAD = "### Instruction:\n"
RESPONSE_HEAD = "\n\n### Response:\n"
PARAGRAPH_OPEN = "[Retrieval]<paragraph>"
PARAGRAPH_CLOSE = "</paragraph>"
# ---------------------------------------------------------------------------------------------


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_contexts(contexts: Column | str) -> Column:
    """ARRAY<STRING> -> 'Context 1:\\n...\\n\\nContext 2:\\n...'."""
    return F.array_join(
        F.transform(_c(contexts), lambda c, i: F.concat(F.lit("Context "), (i + 1).cast("string"), F.lit(":\n"), c)),
        "\n\n",
    )


def context_prompt(contexts: Column | str, question: Column | str) -> Column:
    """User message: formatted contexts (none: nothing), a blank line, then 'Question: ...'."""
    return F.concat(F.coalesce(format_contexts(contexts), F.lit("")), F.lit("\n\nQuestion: "), _c(question))


def single_context_prompt(context: Column | str, question: Column | str) -> Column:
    return F.concat(F.lit("Context:\n"), _c(context), F.lit("\n\nQuestion: "), _c(question))


def instruction_prompt(instruction: Column | str, paragraph: Column | str | None = None) -> Column:
    head = F.concat(F.lit(INSTRUCTION_HEAD), _c(instruction), F.lit(RESPONSE_HEAD))
    if paragraph is None:
        return head
    p = _c(paragraph)
    return F.when(p.isNotNull() & (p != ""), F.concat(head, F.lit(PARAGRAPH_OPEN), p, F.lit(PARAGRAPH_CLOSE))) \
        .otherwise(head)

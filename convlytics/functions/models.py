"""Offline stand-ins for the chat model used by routing and answer batches.

A chat model here is any callable ``(system_prompt, user_text) -> str``.
These stubs are deterministic so the batch operators run without a model server;
callers pass their own client function in production.
"""

from __future__ import annotations

import json


def keyword_router(system_prompt: str, user_text: str) -> str:
    """Routes on simple cues in the conversation text; replies in JSON."""
    text = (user_text or "").lower()
    if "!" in text or "queja" in text:
        route, sentiment = "escalar", "negativo"
    elif "?" in text:
        route, sentiment = "tecnico", "neutral"
    elif "conversacion:\n\n" in text:
        route, sentiment = "assistant", "neutral"
    else:
        route, sentiment = "resumen", "positivo"
    return "Analisis:\n" + json.dumps({"route": route, "sentiment": sentiment, "motivo": "", "rationale": ""})


def template_answerer(system_prompt: str, user_text: str) -> str:
    """Answers every question with a JSON object holding the expected keys."""
    return json.dumps({
        "summary": user_text or "",
        "insights": ["see context"] if "Contexto" in (system_prompt or "") else [],
        "risks": [],
        "actions": ["review"],
        "metrics_used": ["tasa_escalamiento"],
    }, ensure_ascii=False)

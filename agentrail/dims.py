"""Small fixed dimension tables (prices, providers, path hints, surrogates).

Each table is a literal with a known, fixed number of rows, so broadcasting
it is always safe.  Users may pass their own tables of the same shape; the
operators then check the size before broadcasting (see ``bounded``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the published behaviour for identical results).
# ---------------------------------------------------------------------------

# Per-million-token prices: (model, USD in / 1M, USD out / 1M, provider).
PRICES = [
    ("claude-haiku-4-5-20251001", 0.80, 4.00, "anthropic"),
    ("claude-haiku-4-5", 0.80, 4.00, "anthropic"),
    ("claude-sonnet-4-5", 3.00, 15.00, "anthropic"),
    ("claude-sonnet-4-6", 3.00, 15.00, "anthropic"),
    ("claude-opus-4-1", 15.00, 75.00, "anthropic"),
    ("claude-opus-4-7", 15.00, 75.00, "anthropic"),
    ("gemini-2.0-flash", 0.10, 0.40, "gemini"),
    ("gemini-2.5-flash", 0.30, 2.50, "gemini"),
    ("gemini-2.5-pro", 1.25, 10.00, "gemini"),
    ("gpt-4o-mini", 0.15, 0.60, "openai"),
    ("gpt-4o", 2.50, 10.00, "openai"),
    ("o1-mini", 1.10, 4.40, "openai"),
    ("o1", 15.00, 60.00, "openai"),
]

# Provider (lower-cased) -> model whose price is used for unknown models.
PRICE_DEFAULTS = [
    ("anthropic", "claude-haiku-4-5"),
    ("gemini", "gemini-2.5-flash"),
    ("google", "gemini-2.5-flash"),
    ("openai", "gpt-4o-mini"),
]

# Providers in matching order: (label, host pattern, name, category, strategy).
PROVIDERS = [
    ("anthropic", "api.anthropic.com", "Anthropic", "frontier", "suffix"),
    ("openai", "api.openai.com", "OpenAI", "frontier", "suffix"),
    ("gemini", "generativelanguage.googleapis.com", "Google Gemini", "frontier", "suffix"),
    ("mistral", "api.mistral.ai", "Mistral", "frontier", "suffix"),
    ("mistral-codestral", "codestral.mistral.ai", "Mistral Codestral", "frontier", "suffix"),
    ("cohere", "api.cohere.com", "Cohere", "frontier", "suffix"),
    ("cohere-legacy", "api.cohere.ai", "Cohere (legacy)", "frontier", "suffix"),
    ("xai", "api.x.ai", "xAI Grok", "frontier", "suffix"),
    ("deepseek", "api.deepseek.com", "DeepSeek", "frontier", "suffix"),
    ("ai21", "api.ai21.com", "AI21 Labs", "frontier", "suffix"),
    ("reka", "api.reka.ai", "Reka", "frontier", "suffix"),
    ("aleph-alpha", "api.aleph-alpha.com", "Aleph Alpha", "frontier", "suffix"),
    ("zhipu", "open.bigmodel.cn", "Zhipu GLM", "frontier", "suffix"),
    ("baidu", "aip.baidubce.com", "Baidu ERNIE", "frontier", "suffix"),
    ("alibaba", "dashscope.aliyuncs.com", "Alibaba Qwen", "frontier", "suffix"),
    ("groq", "api.groq.com", "Groq", "inference", "suffix"),
    ("cerebras", "api.cerebras.ai", "Cerebras", "inference", "suffix"),
    ("sambanova", "api.sambanova.ai", "SambaNova", "inference", "suffix"),
    ("together", "api.together.xyz", "Together", "inference", "suffix"),
    ("fireworks", "api.fireworks.ai", "Fireworks", "inference", "suffix"),
    ("deepinfra", "api.deepinfra.com", "DeepInfra", "inference", "suffix"),
    ("hyperbolic", "api.hyperbolic.xyz", "Hyperbolic", "inference", "suffix"),
    ("anyscale", "api.endpoints.anyscale.com", "Anyscale Endpoints", "inference", "suffix"),
    ("nebius", "api.studio.nebius.ai", "Nebius AI Studio", "inference", "suffix"),
    ("lambda", "api.lambdalabs.com", "Lambda Inference", "inference", "suffix"),
    ("lepton", "api.lepton.ai", "Lepton AI", "inference", "suffix"),
    ("siliconflow", "api.siliconflow.com", "SiliconFlow", "inference", "suffix"),
    ("featherless", "api.featherless.ai", "Featherless", "inference", "suffix"),
    ("inference-net", "api.inference.net", "Inference.net", "inference", "suffix"),
    ("modal", "modal.com", "Modal Labs", "inference", "suffix"),
    ("replicate", "api.replicate.com", "Replicate", "inference", "suffix"),
    ("perplexity", "api.perplexity.ai", "Perplexity", "inference", "suffix"),
    ("openrouter", "openrouter.ai", "OpenRouter", "aggregator", "suffix"),
    ("portkey", "api.portkey.ai", "Portkey", "aggregator", "suffix"),
    ("kong-ai", "ai-gateway.konghq.com", "Kong AI Gateway", "aggregator", "suffix"),
    ("vellum", "api.vellum.ai", "Vellum", "aggregator", "suffix"),
    ("azure-openai", "openai.azure.com", "Azure OpenAI", "cloud", "suffix"),
    ("aws-bedrock", "bedrock-runtime", "AWS Bedrock", "cloud", "contains"),
    ("vertex-ai", "aiplatform.googleapis.com", "Google Vertex AI", "cloud", "contains"),
    ("watsonx", "ml.cloud.ibm.com", "IBM watsonx", "cloud", "suffix"),
    ("databricks", "cloud.databricks.com", "Databricks Model Serving", "cloud", "suffix"),
    ("voyage", "api.voyageai.com", "Voyage AI", "embedding", "suffix"),
    ("jina", "api.jina.ai", "Jina AI", "embedding", "suffix"),
    ("nomic", "api-atlas.nomic.ai", "Nomic Atlas", "embedding", "suffix"),
    ("huggingface", "api-inference.huggingface.co", "HuggingFace Inference", "embedding", "suffix"),
    ("huggingface-endpoints", "endpoints.huggingface.cloud", "HuggingFace Endpoints", "embedding", "suffix"),
    ("local", "localhost", "Local server (Ollama / vLLM / LM Studio / LiteLLM)", "local", "suffix"),
    ("local-ip", "127.0.0.1", "Local server (loopback)", "local", "suffix"),
    ("local-net", "0.0.0.0", "Local server (any-iface)", "local", "suffix"),
]

# URL path hints in matching order: (hint, provider).
PATH_HINTS = [
    ("/v1/messages", "anthropic"),
    ("/v1/complete", "anthropic"),
    ("/v1/chat/completions", "openai"),
    ("/v1/responses", "openai"),
    ("/v1/embeddings", "openai"),
    ("/v1beta/models/", "gemini"),
    ("/v1/models/", "gemini"),
    ("/openai/v1/chat", "groq"),
]

# Sparse-autoencoder registry in preference order: (label, model, release, sae_id).
SAE_ENTRIES = [
    ("gpt2-small", "gpt2-small", "gpt2-small-res-jb", "blocks.6.hook_resid_pre"),
    ("gemma-2-2b", "gemma-2-2b", "gemma-scope-2b-pt-res", "layer_20/width_16k/average_l0_71"),
    ("pythia-70m", "pythia-70m-deduped", "pythia-70m-deduped-res-sm", "blocks.4.hook_resid_pre"),
]

# Closed-model family substring -> surrogate label, in declaration order.
SURROGATES = [
    ("claude", "gpt2-small"),
    ("claude-haiku", "gpt2-small"),
    ("claude-sonnet", "gpt2-small"),
    ("claude-opus", "gpt2-small"),
    ("gpt-4", "gpt2-small"),
    ("gpt-4o", "gpt2-small"),
    ("gpt-3.5", "gpt2-small"),
    ("o1", "gpt2-small"),
    ("o3", "gpt2-small"),
    ("gemini", "gemma-2-2b"),
    ("gemini-pro", "gemma-2-2b"),
    ("gemini-flash", "gemma-2-2b"),
]

# Failure categories of an annotation (free text elsewhere; this is the
# recommended vocabulary) and of the benchmark corpus schema.
CORPUS_CATEGORIES = ["hallucination", "loop", "tool-misuse", "off-task",
                     "context-drop", "other"]
SEVERITIES = ["low", "medium", "high", "critical"]

# Largest user-supplied dimension we broadcast without a shuffle join.
MAX_BROADCAST_ROWS = 100_000


def prices_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PRICES, "model string, in_per_m double, out_per_m double, provider string")


def price_defaults_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICE_DEFAULTS, "provider string, model string")


def providers_df(spark: SparkSession) -> DataFrame:
    rows = [(i,) + p for i, p in enumerate(PROVIDERS)]
    return spark.createDataFrame(
        rows, "priority int, label string, host_pattern string, name string, "
              "category string, strategy string")


def path_hints_df(spark: SparkSession) -> DataFrame:
    rows = [(i,) + p for i, p in enumerate(PATH_HINTS)]
    return spark.createDataFrame(rows, "priority int, hint string, provider string")


def sae_entries_df(spark: SparkSession) -> DataFrame:
    rows = [(i,) + p for i, p in enumerate(SAE_ENTRIES)]
    return spark.createDataFrame(
        rows, "priority int, label string, model string, release string, sae_id string")


def surrogates_df(spark: SparkSession) -> DataFrame:
    rows = [(i,) + p for i, p in enumerate(SURROGATES)]
    return spark.createDataFrame(rows, "priority int, family string, label string")


def bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when its size is proven to be small.

    Literal dimension tables (a ``LocalRelation``) are always small.  For
    anything else one bounded count runs on the driver; over the limit the
    table is returned as is and Catalyst / AQE choose a shuffle join.
    """
    try:
        if df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LocalRelation":
            return F.broadcast(df)
    except Exception:  # noqa: BLE001 - no JVM plan access (e.g. Spark Connect): count instead
        pass
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df

"""Documents to Markdown, chunks and measures on Spark."""

from .operators.assemble import documents, element_pages, quality_rollup
from .operators.batch import run_batch, run_benchmark
from .operators.chunk import chunk
from .operators.metrics import document_metrics
from .operators.normalise import reply_pages
from .operators.quality import quality_checks
from .operators.summary import batch_summary, benchmark_summary
from .sources.config import Config
from .sources.files import expand_inputs, read_files
from .sources.manifest import read_manifest
from .sources.readers import ENGINES, read_documents, read_pages, register_engine
from .streaming.ingest import ingest_chunks

__all__ = [
    "ENGINES", "Config", "batch_summary", "benchmark_summary", "chunk", "document_metrics", "documents", "element_pages", "expand_inputs", "ingest_chunks",
    "quality_checks", "quality_rollup", "read_documents", "read_files", "read_manifest", "read_pages", "register_engine", "reply_pages", "run_batch", "run_benchmark",
]

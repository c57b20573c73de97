"""quillframe: document-layout analytics and evaluation on Apache Spark."""

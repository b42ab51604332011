"""inboxlake: message-triage analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame(s) -> DataFrame`` built on Spark SQL
expressions, Arrow (pandas) UDFs where Python is unavoidable, and Structured
Streaming for the incremental paths.  Nothing is collected to the driver.
"""

__version__ = "0.1.0"

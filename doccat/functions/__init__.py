"""Column expressions. Everything here stays in the JVM; nothing triggers a job."""

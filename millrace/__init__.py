"""Millrace: data jobs for customer, equipment and order-event data as Spark DataFrame operators."""

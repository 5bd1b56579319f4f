"""DataFrame operators: tables in, tables out, nothing executed while a plan is built."""

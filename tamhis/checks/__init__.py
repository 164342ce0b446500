"""The registered queries and the SQL that says what each must return."""

"""The registered queries, the mail they run on, and the SQL they are checked against."""

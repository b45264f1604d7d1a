"""parley: Spark operators over meetings, transcripts and conversational text."""

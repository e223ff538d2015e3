"""From a request to a plan: guarded SQL, text to SQL, phrases."""
